"""k-means++ and Lloyd rounds over samples(id, x); centres are k by d on the driver, rows stay in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .pairs import PRIME, mixed

STRATEGIES = ("largest_variance", "largest_points_number", "farthest_point", "error")


class EmptyClusterError(ValueError):
    """A cluster lost all its points and the strategy is "error"."""


def unit_draw(i: Column, turn: int) -> Column:
    """A fixed number in (0, 1) for a row and a turn."""
    return (mixed(i, F.lit(turn), 1) + 0.5) / float(PRIME)


def weighted_draw(weighted: DataFrame, turn: int) -> DataFrame:
    """The row of weighted(id, w) drawn with probability w: the least of -ln(u) / w; one aggregation, no global order."""
    key = -F.log(unit_draw(F.col("id"), turn)) / F.col("w")
    return weighted.where("w > 0").agg(F.min_by("id", F.struct(F.round(key, 9), "id")).alias("id"))


def assign(samples: DataFrame, centres: np.ndarray, scale: np.ndarray | None = None) -> DataFrame:
    """id, x, cluster, d: the nearest centre, ties to the lower; with scale L distances are |L(x - c)|."""
    schema = samples.select("id", "x").schema.add("cluster", "integer").add("d", "double")
    centres = np.asarray(centres, float)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
            for k, c in enumerate(centres):
                diff = x - c if scale is None else (x - c) @ scale.T
                d = (diff * diff).sum(axis=1)
                nearer = d < best
                best[nearer], at[nearer] = d[nearer], k
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(at), pa.array(np.sqrt(best))], names=["id", "x", "cluster", "d"])

    return samples.select("id", "x").mapInArrow(run, schema)


def assign_pruned(samples: DataFrame, centres: np.ndarray) -> DataFrame:
    """As assign, with the triangle inequality: a centre as far from the best one as twice the best distance can't be nearer."""
    schema = samples.select("id", "x").schema.add("cluster", "integer").add("d", "double")
    centres = np.asarray(centres, float)
    apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            at = np.zeros(len(x), np.int32)
            best = np.sqrt(((x - centres[0]) ** 2).sum(axis=1))
            for k in range(1, len(centres)):
                open_ = np.flatnonzero(apart[at, k] < 2 * best)
                d = np.sqrt(((x[open_] - centres[k]) ** 2).sum(axis=1))
                nearer = open_[d < best[open_]]
                best[nearer], at[nearer] = d[d < best[open_]], k
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(at), pa.array(best)], names=["id", "x", "cluster", "d"])

    return samples.select("id", "x").mapInArrow(run, schema)


def means(assigned: DataFrame) -> DataFrame:
    """cluster, i, v: cell means of the members, in the space of x."""
    return assigned.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))


def spread(assigned: DataFrame) -> DataFrame:
    """cluster, n, variance of the members' distances, farthest id."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("variance"), F.max_by("id", F.struct(F.round("d", 9), -F.col("id"))).alias("farthest"))


def replacement(assigned: DataFrame, strategy: str) -> np.ndarray:
    """The point that becomes the centre of an empty cluster."""
    if strategy == "error":
        raise EmptyClusterError("empty cluster")
    if strategy == "farthest_point":
        pick = assigned
    else:
        by = "variance" if strategy == "largest_variance" else "n"
        c = spread(assigned).agg(F.max_by("cluster", F.struct(by, -F.col("cluster"))).alias("c")).first()["c"]
        pick = assigned.where(F.col("cluster") == c)
    return np.array(pick.agg(F.max_by("x", F.struct(F.round("d", 9), -F.col("id"))).alias("x")).first()["x"])


def seed(samples: DataFrame, k: int, scale: np.ndarray | None = None) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to those before."""
    first = samples.agg(F.min_by("x", F.struct(unit_draw(F.col("id"), 0), "id")).alias("x")).first()["x"]
    centres = [np.array(first)]
    while len(centres) < k:
        a = assign(samples, np.array(centres), scale).select("id", "x", (F.col("d") * F.col("d")).alias("w"))
        key = -F.log(unit_draw(F.col("id"), len(centres))) / F.col("w")
        row = a.where("w > 0").agg(F.min_by("x", F.struct(key, "id")).alias("x")).first()["x"]
        if row is None:
            row = samples.agg(F.min_by("x", F.struct(unit_draw(F.col("id"), len(centres)), "id")).alias("x")).first()["x"]
        centres.append(np.array(row))
    return np.array(centres)


def fit(samples: DataFrame, k: int, max_iter: int = -1, strategy: str = "largest_variance", scale: np.ndarray | None = None, centres: np.ndarray | None = None) -> np.ndarray:
    """Centres after Lloyd rounds until no row moves (max_iter -1: without bound)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if k < 1 or samples.limit(k).count() < k:
        raise ValueError("fewer points than clusters, or no cluster asked for")
    c = seed(samples, k, scale) if centres is None else np.asarray(centres, float)
    done = 0
    while max_iter < 0 or done < max_iter:
        a = assign(samples, c, scale)
        new, used = c.copy(), set()
        for r in means(a).collect():  # k times d cells
            new[r["cluster"], r["i"]] = r["v"]
            used.add(r["cluster"])
        empty = [j for j in range(k) if j not in used]
        for j in empty:
            new[j] = replacement(assign(samples, np.delete(new, empty, axis=0), scale), strategy)
            empty = [e for e in empty if e != j]
        done += 1
        if np.allclose(new, c, rtol=0, atol=1e-12):
            return new
        c = new
    return c


def mllib(samples: DataFrame, k: int, max_iter: int = 100, seed_: int = 1) -> np.ndarray:
    """Centres by MLlib, with its parallel seeding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=max_iter, seed=seed_, initMode="k-means||").fit(samples.select(array_to_vector("x").alias("features")))
    return np.array(model.clusterCenters())


def fit_bounds(samples: DataFrame, k: int, max_iter: int = -1, strategy: str = "largest_variance", centres: np.ndarray | None = None) -> np.ndarray:
    """As fit, with bounds kept over the rounds: each row carries an upper bound of its distance and a lower one for every centre, so most distances are never computed."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if k < 1 or samples.limit(k).count() < k:
        raise ValueError("fewer points than clusters, or no cluster asked for")
    c = seed(samples, k) if centres is None else np.asarray(centres, float)
    state = samples.select("id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("d"), F.array_repeat(F.lit(0.0), k).alias("low"))
    moved, done = np.zeros(k), 0
    while max_iter < 0 or done < max_iter:
        state = cut(bounded_round(state, c, moved))
        new, used = c.copy(), set()
        for r in means(state).collect():  # k times d cells
            new[r["cluster"], r["i"]] = r["v"]
            used.add(r["cluster"])
        empty = [j for j in range(k) if j not in used]
        for j in empty:
            new[j] = replacement(assign(samples, np.delete(new, empty, axis=0)), strategy)
            empty = [e for e in empty if e != j]
        done += 1
        if np.allclose(new, c, rtol=0, atol=1e-12):
            return new
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)), new
    return c


def bounded_round(state: DataFrame, centres: np.ndarray, moved: np.ndarray) -> DataFrame:
    """state(id, x, cluster, d, low) after the centres moved so far; d is an upper bound, rows that it settles are not compared."""
    apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2)) / 2
    k = len(centres)
    nearest = np.where(np.eye(k, dtype=bool), np.inf, apart).min(axis=1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            at = b.column("cluster").to_numpy(zero_copy_only=False).copy()
            low = np.maximum(b.column("low").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k) - moved, 0.0)
            high = b.column("d").to_numpy(zero_copy_only=False) + moved[at]
            open_ = np.flatnonzero(high >= nearest[at])
            high[open_] = np.sqrt(((x[open_] - centres[at[open_]]) ** 2).sum(axis=1))
            low[open_, at[open_]] = high[open_]
            for j in range(k):
                o = open_[(at[open_] != j) & (high[open_] >= low[open_, j]) & (high[open_] >= apart[at[open_], j])]
                d = low[o, j] = np.sqrt(((x[o] - centres[j]) ** 2).sum(axis=1))
                nearer = (d < high[o]) | ((d == high[o]) & (j < at[o]))
                high[o[nearer]], at[o[nearer]] = d[nearer], j
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(at), pa.array(high), pa.array(low.tolist(), pa.list_(pa.float64()))], names=["id", "x", "cluster", "d", "low"])

    return state.mapInArrow(run, state.schema)


def codebook(samples: DataFrame, type_: str, centres: np.ndarray) -> DataFrame:
    return samples.sparkSession.createDataFrame([(type_, i, [float(v) for v in c]) for i, c in enumerate(centres)], "type string, word int, center array<double>")
