"""Superpixel features: colour, colour-name, gradient and texture histograms, long by bin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pixels as P

#: Feature types by their fixed ordinal.
TYPES = ("HSV", "CN", "HOG", "SILTP", "ALL", "OPQ_1", "OPQ_2", "OPQ_3", "OPQ_4")
SIZES = {"HSV": 100, "CN": 11, "HOG": 9, "SILTP": 162}
KEY = ["image_id", "sp"]


def hellinger_long(counts: DataFrame, value: str, whole: bool) -> DataFrame:
    """v = sqrt(value / its superpixel's sum); sums of 0 (or, with whole, under 1) leave the values undivided."""
    sums = counts.groupBy(*KEY).agg(F.sum(value).alias("s"))
    guard = F.floor("s") != 0 if whole else F.col("s") > 0
    v = F.sqrt(F.when(guard, F.col(value) / F.col("s")).otherwise(F.col(value)))
    return counts.join(sums, KEY).select(*KEY, "bin", v.alias("v"))


def hsv(superpixels: DataFrame) -> DataFrame:
    x = superpixels.withColumn("bin", P.hsv_bin(*map(F.col, P.RGB)))
    return hellinger_long(x.groupBy(*KEY, "bin").agg(F.count("*").cast("double").alias("n")), "n", True)


def colour_table(spark: SparkSession) -> DataFrame:
    """idx and p, the probabilities of 11 colour names: a generated stand-in of 32**3 rows, fixed in size."""
    p = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda j: ((F.col("id") * 31 + j * 17) % 101).cast("double") / 101.0)
    return spark.range(32**3).select(F.col("id").cast("int").alias("idx"), p.alias("p"))


def colour_names(superpixels: DataFrame, table: DataFrame) -> DataFrame:
    """sqrt of the mean probability of each name. The table has 32**3 rows at any scale, so it is broadcast."""
    x = superpixels.withColumn("idx", P.colour_index(*map(F.col, P.RGB))).join(F.broadcast(table), "idx")
    means = x.groupBy(*KEY).agg(F.array(*[F.avg(F.col("p")[j]) for j in range(11)]).alias("m"))
    return means.select(*KEY, F.posexplode("m").alias("bin", "m")).select(*KEY, "bin", F.sqrt("m").alias("v"))


def hog(superpixels: DataFrame) -> DataFrame:
    x = P.gradients(superpixels).withColumn("bin", F.col("bin") - 1)
    return hellinger_long(x.groupBy(*KEY, "bin").agg(F.sum("magnitude").alias("n")), "n", False)


def siltp(superpixels: DataFrame, radii: tuple[int, int] = (12, 20)) -> DataFrame:
    both = None
    for i, r in enumerate(radii):
        x = P.siltp(superpixels, r).groupBy(*KEY, (F.col("code") + 81 * i).alias("bin")).agg(F.count("*").cast("double").alias("n"))
        both = x if both is None else both.unionByName(x)
    return hellinger_long(both, "n", True)


def dense(long: DataFrame, size: int) -> DataFrame:
    """image_id, sp, feat: arrays of all bins."""
    cells = long.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))
    feat = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return cells.select(*KEY, feat.alias("feat"))


#: Extension point: type to a function of the superpixel table.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"HSV": hsv, "HOG": hog}


def register(type_: str, size: int, make: Callable[[DataFrame], DataFrame]) -> None:
    """Add a feature type: make(superpixels) gives image_id, sp, bin, v with bins from 0 to size - 1."""
    REGISTRY[type_], SIZES[type_] = make, size


def table(superpixels: DataFrame, radii: tuple[int, int] = (12, 20), types=("HSV", "CN", "HOG", "SILTP"), colours: DataFrame | None = None) -> DataFrame:
    """image_id, sp, type, feat for the named types; further types come from REGISTRY. colours(idx, p) replaces the generated colour names."""
    made = {"SILTP": lambda x: siltp(x, radii), "CN": lambda x: colour_names(x, colour_table(x.sparkSession) if colours is None else colours)} | REGISTRY
    out = None
    for t in types:
        part = dense(made[t](superpixels), SIZES[t]).withColumn("type", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


def fused(features: DataFrame) -> DataFrame:
    """Type ALL: the features of a superpixel one behind the other in the order of TYPES."""
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "feat"))), lambda x: x["feat"])
    return features.groupBy(*KEY).agg(F.flatten(parts).alias("feat")).withColumn("type", F.lit("ALL"))
