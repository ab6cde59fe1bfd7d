"""Superpixels: patch grids, and simple linear iterative clustering per image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def patches(pixels: DataFrame, size: int, width: int, mode: str = "full") -> DataFrame:
    """pixels with sp, the number of their patch; mode "diagonal" keeps a patch's diagonal pixels only."""
    x = pixels.withColumn("sp", (F.floor(F.col("row") / size) * (width // size) + F.floor(F.col("col") / size)).cast("int"))
    return x.where(F.col("row") % size == F.col("col") % size) if mode == "diagonal" else x


def foreground(superpixels: DataFrame) -> DataFrame:
    """image_id, sp of superpixels with any pixel in the mask."""
    return superpixels.groupBy("image_id", "sp").agg(F.max((F.col("mask") != 0).cast("int")).alias("fg")).where("fg = 1").drop("fg")


def members(superpixels: DataFrame) -> DataFrame:
    """A row a superpixel with its pixels in raster order."""
    pixel = F.struct("row", "col")
    return superpixels.groupBy("image_id", "sp").agg(F.array_sort(F.collect_list(pixel)).alias("pixels"))


def seed_grid(width: int, height: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    """Step and (x, y) of about n seeds, the remainder of each side spread over its strips."""
    step = max(1, int((width * height / n) ** 0.5 + 0.5))

    def axis(length: int) -> list[int]:
        strips = int(0.5 + length / step)
        rest = length - step * strips
        if rest < 0:
            strips -= 1
            rest = length - step * strips
        strips = max(strips, 1)
        return [min(length - 1, i * step + step // 2 + int(i * (rest / strips))) for i in range(strips)]

    return step, [(x, y) for y in axis(height) for x in axis(width)]


def seeds(spark: SparkSession, width: int, height: int, n: int) -> DataFrame:
    """seed, x, y: the same closed form as columns."""
    step, _ = seed_grid(width, height, n)
    side = {}
    for name, length in (("x", width), ("y", height)):
        strips = int(0.5 + length / step)
        strips -= length - step * strips < 0
        strips = max(strips, 1)
        err = (length - step * strips) / strips
        i = F.col("id")
        side[name] = (strips, F.least(F.lit(length - 1), i * step + step // 2 + F.floor(i * F.lit(err))).cast("int"))
    columns, x = side["x"]
    rows, y = side["y"]
    grid = spark.range(rows * columns).select(F.col("id").alias("seed"))
    at = lambda expr, i: grid.select("seed", i.alias("id")).select("seed", expr)
    xs = at(x.alias("x"), F.col("seed") % columns)
    ys = at(y.alias("y"), F.floor(F.col("seed") / columns))
    return xs.join(ys, "seed")


# Fixed values of public standards: sRGB to XYZ under D65, CIE Lab.
def _lab(rgb: np.ndarray) -> np.ndarray:
    v = rgb / 255.0
    v = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    m = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
    t = v @ m.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(t > 0.008856, np.cbrt(t), (903.3 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def cluster(rgb: np.ndarray, n: int, compactness: float, rounds: int = 10) -> np.ndarray:
    """Labels of an image (h, w, 3): nearest centre in colour and place among those within a step, centres moved, small pieces merged.

    A pixel that no centre reaches keeps the label it had, -1 at first, and counts for no centre; a centre without pixels goes to the origin.
    """
    h, w = rgb.shape[:2]
    step, at = seed_grid(w, h, n)
    colour = _lab(rgb)
    rows, cols = np.mgrid[:h, :w]
    centres = np.array([[*colour[y, x], x, y] for x, y in at], float)
    weight = (compactness / step) ** 2
    labels = np.full((h, w), -1)
    values = np.concatenate([colour, cols[..., None], rows[..., None]], axis=-1).reshape(-1, 5)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for k, c in enumerate(centres):
            near = np.s_[max(0, int(c[4] - step)) : max(0, min(h, int(c[4] + step))), max(0, int(c[3] - step)) : max(0, min(w, int(c[3] + step)))]
            d = ((colour[near] - c[:3]) ** 2).sum(-1) + ((cols[near] - c[3]) ** 2 + (rows[near] - c[4]) ** 2) * weight
            nearer = d < best[near]
            best[near][nearer] = d[nearer]
            labels[near][nearer] = k
        told = labels.ravel() >= 0
        flat = labels.ravel()[told]
        counts = np.maximum(np.bincount(flat, minlength=len(centres)), 1)
        centres = np.stack([np.bincount(flat, values[told, j], len(centres)) / counts for j in range(5)], axis=1)
    return connected(labels, (h * w // n) >> 2)


def connected(labels: np.ndarray, least: int) -> np.ndarray:
    """Four-connected pieces numbered in raster order. A piece of `least` pixels or fewer takes the label seen last beside a piece's first pixel, its own or an earlier piece's (left, above, right, below)."""
    h, w = labels.shape
    out = np.full((h, w), -1)
    n = beside = 0

    def around(y: int, x: int):
        return ((b, a) for b, a in ((y, x - 1), (y - 1, x), (y, x + 1), (y + 1, x)) if 0 <= a < w and 0 <= b < h)

    for y, x in np.ndindex(h, w):
        if out[y, x] >= 0:
            continue
        for p in around(y, x):
            beside = out[p] if out[p] >= 0 else beside
        piece = [(y, x)]
        out[y, x] = n
        for p in piece:
            for q in around(*p):
                if out[q] < 0 and labels[q] == labels[y, x]:
                    out[q] = n
                    piece.append(q)
        if len(piece) <= least:
            for p in piece:
                out[p] = beside
        else:
            n += 1
    return out


def slic(pixels: DataFrame, n: int, compactness: float) -> DataFrame:
    """pixels with sp by clustering; one group an image."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        rgb = np.zeros((h, w, 3))
        for i, c in enumerate(("red", "green", "blue")):
            rgb[pdf["row"], pdf["col"], i] = pdf[c]
        labels = cluster(rgb, n, compactness)
        return pd.DataFrame({"image_id": pdf["image_id"], "row": pdf["row"], "col": pdf["col"], "mask": pdf["mask"], "sp": labels[pdf["row"], pdf["col"]]})

    return pixels.groupBy("image_id").applyInPandas(one, "image_id long, row int, col int, mask int, sp int")
