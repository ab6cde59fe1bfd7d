"""Sums of outer products: each task adds up its own d by d partial, partials are added by cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "grp string, i int, j int, v double, n double"


def scatter(df: DataFrame, x: Column, weight: Column | None = None, group: Column | None = None) -> DataFrame:
    """grp, i, j, v, n: the sum of w x x' and of w, over all rows or by group. Only cells with i <= j are summed, then mirrored."""
    rows = df.select((F.lit("") if group is None else group.cast("string")).alias("g"), x.alias("x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))

    def partials(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = batch.column("w").to_numpy()
            names, at = np.unique(np.array(batch.column("g").fill_null("").to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(names):
                v, u = values[at == k], w[at == k]
                m, n = sums.get(name, (0.0, 0.0))
                sums[name] = m + (v * u[:, None]).T @ v, n + u.sum()
        for name, (m, n) in sums.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"grp": [name] * len(i), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": m[i, j], "n": np.full(len(i), n)})

    half = rows.mapInArrow(partials, CELLS).groupBy("grp", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select("grp", F.explode(mirrored).alias("c"), "v", "n").select("grp", "c.i", "c.j", "v", "n")


def to_matrix(cells: DataFrame, mean: bool = True) -> np.ndarray:
    """The d by d matrix on the driver; d is the length of a vector, not of the data."""
    rows = cells.collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    m = np.zeros((d, d))
    for r in rows:
        m[r["i"], r["j"]] = r["v"] / r["n"] if mean else r["v"]
    return m


def covariance(df: DataFrame, x: Column, weight: Column | None = None) -> DataFrame:
    """i, j, v: the mean outer product."""
    return scatter(df, x, weight).select("i", "j", (F.col("v") / F.col("n")).alias("v"))


def vector_sums(df: DataFrame, x: Column, *keys: str) -> DataFrame:
    """keys, i, s, n: sums of the vectors' cells."""
    return df.select(*keys, F.posexplode(x).alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))


def mean_vector(df: DataFrame, x: Column) -> DataFrame:
    return vector_sums(df, x).select("i", (F.col("s") / F.col("n")).alias("v"))


def label_pair_mean(samples: DataFrame, label: str = "person", side: str = "cam") -> np.ndarray:
    """The mean of (a-b)(a-b)' over all pairs of one label and different sides of samples(label, side, x), each once, without making the pairs.

    Pairs of n rows sum to n Sxx' - (Sx)(Sx)', taken by label and less those by label and side. Vectors are centred
    first, so that far-off ones lose no digits. Without pairs the matrix is empty.
    """
    x = samples.where(F.col(label).isNotNull() & F.col(side).isNotNull()).select(label, side, "x")
    centre = [r["v"] for r in mean_vector(x, F.col("x")).orderBy("i").collect()]
    if not centre:
        return np.zeros((0, 0))
    x = x.withColumn("x", F.zip_with("x", F.array(*map(F.lit, centre)), lambda v, m: v - m))
    by_side = x.groupBy(label, side).agg(F.count("*").alias("n_side"))
    by_label = by_side.groupBy(label).agg(F.sum("n_side").alias("n_label"))
    square = lambda df, c: df.agg(F.sum(F.col(c) * (F.col(c) - 1))).first()[0] or 0
    n = (square(by_label, "n_label") - square(by_side, "n_side")) / 2
    if not n:
        return np.zeros((0, 0))
    weights = by_side.join(by_label, label).select(label, side, (F.col("n_label") - F.col("n_side")).cast("double").alias("w"))
    sums = vector_sums(x, F.col("x"), label, side)
    rows = lambda cells, *keys: cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("x"))
    whole = rows(sums.groupBy(label, "i").agg(F.sum("s").alias("s")), label).select("x", F.lit(-1.0).alias("w"))
    parts = rows(sums, label, side).select("x", F.lit(1.0).alias("w"))
    every = x.join(weights, [label, side]).select("x", "w").unionByName(whole).unionByName(parts)
    return to_matrix(scatter(every, F.col("x"), F.col("w")), mean=False) / n


def class_pair_scatter(samples: DataFrame, x: Column, label: str = "person", side: str = "cam") -> DataFrame:
    """i, j, v, n: the sum of (a-b)(a-b)' over all pairs of one label with a at side 0 and b at side 1, without making the pairs.

    Per label with m at side 1 and n at side 0 it is m Sxx' + n Syy' - Sx Sy' - Sy Sx'.
    """
    counts = samples.groupBy(label).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("n1"))
    within = samples.join(counts, label)
    weighted = scatter(within, x, F.when(F.col(side) == 0, F.col("n1")).otherwise(F.col("n0")).cast("double")).select("i", "j", "v")
    sums = vector_sums(samples, x, label, side)
    s0 = sums.where(F.col(side) == 0).select(label, F.col("i"), F.col("s").alias("s0"))
    s1 = sums.where(F.col(side) == 1).select(label, F.col("i").alias("j"), F.col("s").alias("s1"))
    half = s0.join(s1, label).groupBy("i", "j").agg(F.sum(F.col("s0") * F.col("s1")).alias("c"))
    other = half.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("c").alias("c2"))
    pairs = counts.agg(F.sum(F.col("n0") * F.col("n1")).cast("double").alias("n"))
    x2 = weighted.join(half, ["i", "j"], "left").join(other, ["i", "j"], "left")
    n = pairs.first()["n"] or 0.0
    return x2.select("i", "j", (F.col("v") - F.coalesce("c", F.lit(0.0)) - F.coalesce("c2", F.lit(0.0))).alias("v"), F.lit(float(n)).alias("n"))
