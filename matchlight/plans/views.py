"""Test views over the table embeddings: samples, pixels, superpixels, words, metrics, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import strips as S
from ..operators import superpixel

#: Side of the raster that a 64-d vector is read as, and of a patch.
SIDE, PATCH = 8, 2


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    person = F.when((F.col("label") == 9) & (F.col("vec_id") % 3 == 0), F.lit(-1)).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("id"), person.cast("int").alias("person"), (F.col("vec_id") % 2).cast("int").alias("cam"), (F.col("vec_id") % 10 == 0).alias("is_query"), F.col("embedding").cast("array<double>").alias("x"))


def probes(s: DataFrame) -> DataFrame:
    """The stated query set: every tenth vector."""
    return s.where("is_query")


def gallery(s: DataFrame) -> DataFrame:
    return s.where("not is_query")


def channel(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((4 * v + 1) * 127.5))).cast("int")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    x = samples(spark, sf).select(F.col("id").alias("image_id"), "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    at = lambda k: F.get("x", (F.col("p") + k) % 64)
    row, col = F.floor(F.col("p") / SIDE).cast("int"), (F.col("p") % SIDE).cast("int")
    parts = F.array(*map(F.lit, S.BODY_PARTS))
    mask = F.when(col.isin(0, SIDE - 1), F.lit(0)).otherwise(F.get(parts, F.floor(row * 5 / SIDE).cast("int")))
    return x.select("image_id", row.alias("row"), col.alias("col"), channel(at(0)).alias("red"), channel(at(21)).alias("green"), channel(at(42)).alias("blue"), mask.cast("int").alias("mask"))


def superpixels(spark: SparkSession, sf: str) -> DataFrame:
    return superpixel.patches(pixels(spark, sf), PATCH, SIDE)


def words(spark: SparkSession, n: int = 12, d: int = 9) -> DataFrame:
    """A generated codebook for gradient histograms."""
    cell = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: ((F.col("id") * 7 + j * 3) % 11).cast("double") / 11.0)
    return spark.range(n).select(F.lit("HOG").alias("type"), F.col("id").cast("int").alias("word"), cell.alias("center"))


def centres(n: int = 8, d: int = 64) -> list[list[float]]:
    """Generated cluster centres."""
    return [[((k * 5 + j * 3) % 13 - 6) / 40.0 for j in range(d)] for k in range(n)]


def diagonal(d: int = 64, shift: int = 0) -> list[float]:
    return [1.0 + ((j + shift) % 5) / 4.0 for j in range(d)]


def sides(s: DataFrame, trials: int = 2) -> tuple[DataFrame, DataFrame]:
    """trial, id, x of both cameras: ids 2i and 2i + 1 are one object, which takes their half as its id here; a trial has its share of them."""
    t = F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
    x = s.select(F.floor(F.col("id") / 2).alias("id"), "cam", "x", t.alias("trial")).where((F.col("id") + F.col("trial")) % trials == 0)
    return x.where("cam = 0").select("trial", "id", "x"), x.where("cam = 1").select("trial", "id", "x")


def matches(s: DataFrame, trials: int = 2) -> DataFrame:
    """trial, probe, gallery, match, a, b: a trial tests every pair of its sides."""
    a, b = sides(s, trials)
    a = a.select("trial", F.col("id").alias("probe"), F.col("x").alias("a"))
    b = b.select("trial", F.col("id").alias("gallery"), F.col("x").alias("b"))
    return a.join(b, "trial").select("trial", "probe", "gallery", (F.col("probe") == F.col("gallery")).alias("match"), "a", "b")
