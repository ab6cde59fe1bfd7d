"""Horizontal strips of superpixels, by mean row or by body part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mask labels of the five body parts, top to bottom.
BODY_PARTS = (56, 79, 96, 110, 136)


def strips(superpixels: DataFrame, height: int, length: int, step: int, shift: int = 0, band: str = "mid") -> DataFrame:
    """image_id, strip, band, sp: every strip whose range holds the superpixel's mean row (moved by shift)."""
    n = (height - length) // step + 1
    centre = superpixels.groupBy("image_id", "sp").agg(F.avg("row").alias("c"))
    c = F.col("c") + shift
    first = F.greatest(F.floor((c - length + step) / step), F.lit(0))
    last = F.floor(c / step)
    x = centre.where(last >= first).withColumn("strip", F.explode(F.sequence(first, last))).where(F.col("strip") < n)
    return x.select("image_id", F.col("strip").cast("int").alias("strip"), F.lit(band).alias("band"), "sp")


def bands(superpixels: DataFrame, height: int, length: int, step: int, shift: int) -> DataFrame:
    """Strips of the superpixels as they are, and moved up and down."""
    mid = strips(superpixels, height, length, step)
    return mid.unionByName(strips(superpixels, height, length, step, shift, "low")).unionByName(strips(superpixels, height, length, step, -shift, "high"))


def body_strips(superpixels: DataFrame) -> DataFrame:
    """A superpixel is in the strip of every body part that it touches."""
    part = F.array_position(F.array(*map(F.lit, BODY_PARTS)), F.col("mask"))
    x = superpixels.select("image_id", "sp", part.alias("p")).where("p > 0").distinct()
    return x.select("image_id", (F.col("p") - 1).cast("int").alias("strip"), F.lit("mid").alias("band"), "sp")


def distinct_superpixels(strip_table: DataFrame) -> DataFrame:
    return strip_table.select("image_id", "sp").distinct()
