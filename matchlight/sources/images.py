"""Image and label sources: directory scans, names to ids, masks, text matrices, histogram files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names that count as images.
PATTERN = r"^[^\s]+(\.(?i)(jpg|png|gif|bmp))$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name and image of the image files of a folder, by name."""
    reader = spark.read.format("image").option("dropInvalid", True)
    x = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    x = x.withColumn("path", F.col("image.origin")).withColumn("name", file_name(F.col("path")))
    return x.where(F.col("name").rlike(PATTERN)).select("path", "name", "image").orderBy("name")


def listing(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """name, id (first four characters) and cam (seventh) of a folder's files; contents are not read."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(file_name(F.col("path")).alias("name"))
    return x.select("name", F.substring("name", 1, 4).alias("id"), F.substring("name", 7, 1).alias("cam"))


def pixels(images: DataFrame, key: str = "name") -> DataFrame:
    """image_id, row, col, red, green, blue of images with BGR bytes; one group of rows an image, made where the image lies."""
    import numpy as np
    import pandas as pd

    flat = images.select(F.xxhash64(key).alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = np.repeat(a, 3, axis=2) if r.nChannels == 1 else a
                rows, cols = np.divmod(np.arange(r.height * r.width), r.width)
                yield pd.DataFrame({"image_id": r.image_id, "row": rows, "col": cols, "red": a[..., 2].ravel().astype(int), "green": a[..., 1].ravel().astype(int), "blue": a[..., 0].ravel().astype(int)})

    return flat.mapInPandas(run, "image_id long, row int, col int, red int, green int, blue int")


def mask_name(name: Column, dataset: str) -> Column:
    """Name of an image's mask: another extension; img becomes man in one data set."""
    stem = F.regexp_replace(name, r"\.[^.]+$", ".bmp")
    return F.regexp_replace(stem, "^img", "man") if dataset == "prid450s" else stem


def with_masks(images: DataFrame, masks: DataFrame, dataset: str) -> DataFrame:
    return images.withColumn("mask_name", mask_name(F.col("name"), dataset)).join(masks.select(F.col("name").alias("mask_name"), F.col("image").alias("mask")), "mask_name")


def identity(name: Column, dataset: str) -> tuple[Column, Column, Column]:
    """Person, camera and camera pair (null where a data set has none) that a file name tells."""
    parts = F.split(name, "_")
    none = F.lit(None).cast("string")
    if dataset == "viper":
        return parts[0], none, none
    if dataset == "market":
        return parts[0], F.substring(parts[1], 1, 2), none
    if dataset == "market_eval":
        return parts[0], F.substring(parts[1], 2, 1), none
    if dataset == "cuhk01":
        return F.substring(name, 1, 4), F.floor((F.substring(name, 5, 3).cast("int") + 1) / 2).cast("string"), none
    if dataset == "prid450s":
        return F.split(F.split(name, r"\.")[0], "_")[1], none, none
    if dataset == "cuhk03":
        return parts[1], F.when(F.regexp_extract(parts[2], r"^(\d+)", 1).cast("int") > 5, "2").otherwise("1"), parts[0]
    raise ValueError(f"unknown data set {dataset}")


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """x: the numbers of each line."""
    line = F.trim("value")
    return spark.read.text(path).where(line != "").select(F.split(line, r"\s+").cast("array<double>").alias("x"))


def colour_names(spark: SparkSession, path: str, name: str = "w2c") -> DataFrame:
    """idx, p: the colour-name probabilities of a MAT file, an array of one row for each of the 32**3 colours."""
    from . import mat5

    return mat5.codebook(mat5.read(spark, path, name)).select(F.col("word").alias("idx"), F.col("center").alias("p"))


def histogram_lines(df: DataFrame, h: str) -> DataFrame:
    """value: one line a histogram, joined by commas; written with df.write.text."""
    return df.select(F.array_join(F.col(h).cast("array<string>"), ",").alias("value"))
