"""Nearest neighbours: classification, targets, impostors, hinge sums and energies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..scratch import cut
from .score import KERNELS, Probes, compare, nearest, score


def neighbours(test: DataFrame, train: DataFrame, k: int, measure=vec.squared_distance, skip_self: bool = False) -> DataFrame:
    """test, train, label, d, rk: the k nearest rows of train; ties to the lower id. Each batch of train rows keeps k for each probe only."""
    apart = (lambda g, p: g["id"][:, None] != p["id"][None, :]) if skip_self else None
    s = score(test, train, measure, ("id", "person"), pick=nearest(k, apart))
    return ranked(s, k).select(F.col("probe_id").alias("test"), F.col("probe_person").alias("truth"), F.col("gallery_id").alias("train"), F.col("gallery_person").alias("label"), F.col("score").alias("d"), "rk")


def ranked(s: DataFrame, k: int) -> DataFrame:
    """The k least scores of each probe among those that batches kept, with rk."""
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("probe_id").orderBy("score", "gallery_id"))).where(F.col("rk") <= k)


def vote(near: DataFrame, k: int, first_bonus: float = 0.0) -> DataFrame:
    """test, truth, label by majority of the k nearest; the bonus goes to the first neighbour's label, ties to the lower label."""
    tally = near.where(F.col("rk") <= k).groupBy("test", "truth", "label").agg((F.count("*") + first_bonus * F.max((F.col("rk") == 1).cast("int"))).alias("v"))
    return tally.groupBy("test", "truth").agg(F.min_by(F.col("label"), F.struct((-F.col("v")).alias("v"), "label")).alias("label"))


def error_rate(near: DataFrame, ks: tuple[int, ...], first_bonus: float = 0.01) -> DataFrame:
    """k, error."""
    out = None
    for k in ks:
        part = vote(near, k, first_bonus).agg(F.lit(k).alias("k"), F.avg((F.col("truth") != F.col("label")).cast("double")).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def cv_accuracy(samples: DataFrame, folds: int, k: int) -> DataFrame:
    """fold, accuracy: rows fall in folds by a fixed shuffle of their ids."""
    x = samples.withColumn("fold", F.pmod(F.col("id") * 7919 + 13, F.lit(folds)).cast("int"))
    out = None
    for f in range(folds):
        v = vote(neighbours(x.where(F.col("fold") == f), x.where(F.col("fold") != f), k), k)
        part = v.agg(F.lit(f).alias("fold"), F.avg((F.col("truth") == F.col("label")).cast("double")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def target_neighbours(samples: DataFrame, k: int) -> DataFrame:
    """i, j, d, rk: the k nearest of the same person."""
    s = score(samples, samples, vec.squared_distance, ("id", "person"), ("person",), nearest(k, lambda g, p: g["id"][:, None] != p["id"][None, :]))
    return ranked(s, k).select(F.col("probe_id").alias("i"), F.col("gallery_id").alias("j"), F.col("score").alias("d"), "rk")


def margins(samples: DataFrame, k: int, extra: float = 1.0) -> DataFrame:
    """i, margin: the distance to the farthest target, plus extra."""
    return target_neighbours(samples, k).groupBy("i").agg((F.max("d") + extra).alias("margin"))


def impostors(samples: DataFrame, margin: DataFrame) -> DataFrame:
    """i, l, d: rows of another person nearer to i than either row's margin."""
    x = samples.join(margin.withColumnRenamed("i", "id"), "id").select("id", "person", "x", "margin")
    near = lambda s, p, g: (g["person"][:, None] != p["person"][None, :]) & (s < np.maximum(g["margin"][:, None], p["margin"][None, :]))
    s = score(x, x, vec.squared_distance, ("id", "person", "margin"), pick=near)
    return s.select(F.col("probe_id").alias("i"), F.col("gallery_id").alias("l"), F.col("score").alias("d"))


def hinge_sums(distances: DataFrame, limit: Column) -> DataFrame:
    """i, s: sum of max(limit - d, 0)."""
    return distances.groupBy("i").agg(F.sum(F.greatest(limit - F.col("d"), F.lit(0.0))).alias("s"))


def energy_classify(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """test, truth, label of least energy: distances to the label's k nearest rows, plus hinges of all others inside that margin.

    Two comparisons in blocks: the first keeps k rows of each label for each probe, the second gives sums of hinges.
    """

    def of_each_label(scores: np.ndarray, p: dict, g: dict) -> np.ndarray:
        mask, take = np.zeros(scores.shape, bool), nearest(k)
        for label in np.unique(g["person"]):
            at = np.flatnonzero(g["person"] == label)
            mask[at] = take(scores[at], p, {"id": g["id"][at]})
        return mask

    s = score(test, train, vec.squared_distance, ("id", "person"), pick=of_each_label)
    w = Window.partitionBy("probe_id", "gallery_person").orderBy("score", "gallery_id")
    near = s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    friends = cut(near.groupBy(F.col("probe_id").alias("id"), F.col("gallery_person").alias("label")).agg(F.sum("score").alias("pull"), (F.max("score") + 1.0).alias("margin")))
    own = friends.groupBy("id").agg(F.collect_list("label").alias("labels"), F.collect_list("margin").alias("margins"))

    def hinges(scores: np.ndarray, p: dict, g: dict) -> dict:
        out: dict = {"id": [], "label": [], "push": []}
        for j, (labels, margins) in enumerate(zip(p["labels"], p["margins"])):
            h = np.maximum(np.array(margins)[None, :] - scores[:, j][:, None], 0.0) * (g["person"][:, None] != np.array(labels)[None, :])
            out["id"] += [p["id"][j]] * len(labels)
            out["label"] += list(labels)
            out["push"] += h.sum(axis=0).tolist()
        return out

    probes = Probes(test.join(own, "id"), ("id", "labels", "margins"))
    made = f"id {dict(test.dtypes)['id']}, label {dict(train.dtypes)['person']}, push double"
    push = compare(probes, train, KERNELS[vec.squared_distance], make=hinges, made=made).groupBy("id", "label").agg(F.sum("push").alias("push"))
    energy = friends.join(push, ["id", "label"]).join(test.select("id", F.col("person").alias("truth")), "id")
    return energy.groupBy(F.col("id").alias("test"), "truth").agg(F.min_by(F.col("label"), F.struct(F.round(F.col("pull") + F.col("push"), 9), "label")).alias("label"))


def value_counts(df: DataFrame, value: str, bins: DataFrame) -> DataFrame:
    """bin, n for every bin of bins(bin), zeros included."""
    n = df.groupBy(F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def bag_match(bags: DataFrame) -> DataFrame:
    """a, b, overlaps, shared and logistic, a weight from 0 to 1 of the shared, of pairs of label sets: bags(a, b, la, lb)."""
    shared = F.size(F.array_intersect("la", "lb"))
    return bags.select("a", "b", F.arrays_overlap("la", "lb").alias("overlaps"), shared.alias("shared"), F.tanh(shared / 2).alias("logistic"))


def nearest_impostors(samples: DataFrame, k: int) -> DataFrame:
    """i, l, d, rk: the k nearest rows of other persons."""
    other = nearest(k, lambda g, p: g["person"][:, None] != p["person"][None, :])
    s = ranked(score(samples, samples, vec.squared_distance, ("id", "person"), pick=other), k)
    return s.select(F.col("probe_id").alias("i"), F.col("gallery_id").alias("l"), F.col("score").alias("d"), "rk")
