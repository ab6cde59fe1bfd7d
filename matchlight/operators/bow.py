"""Visual words: votes of superpixels, strip histograms and descriptors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec

TOP, SIGMA = 10, 3.0
#: A codebook is broadcast up to so many words; beyond, each superpixel meets it in blocks of BLOCK_WORDS.
BROADCAST_WORDS, BLOCK_WORDS = 10_000, 1024


def votes(features: DataFrame, codebook: DataFrame, k: int = TOP, metric: Column | None = None) -> DataFrame:
    """features(image_id, sp, type, feat) to (image_id, sp, type, word, distance, rank): the k nearest words, ties to the lower word.

    The codebook (type, word, center) joins as one array a type, so a superpixel makes
    one row; the nearest words are cut from the sorted array before rows are made.
    """
    entries = F.array_sort(F.collect_list(F.struct("word", "center")))
    measure = (lambda c: vec.euclidean(F.col("feat"), c)) if metric is None else (lambda c: vec.mahalanobis(F.col("feat"), c, metric))
    near = F.slice(F.array_sort(F.transform("book", lambda b: F.struct(measure(b["center"]).alias("distance"), b["word"].alias("word")))), 1, k)
    if codebook.count() <= BROADCAST_WORDS:
        x = features.join(F.broadcast(codebook.groupBy("type").agg(entries.alias("book"))), "type")
    else:
        books = codebook.groupBy("type", F.floor(F.col("word") / BLOCK_WORDS).alias("block")).agg(entries.alias("book"))
        n_blocks = int(codebook.agg(F.max("word")).first()[0]) // BLOCK_WORDS + 1
        dealt = features.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        x = dealt.join(books, ["type", "block"]).select("image_id", "sp", "type", near.alias("part"))
        x = x.groupBy("image_id", "sp", "type").agg(F.flatten(F.collect_list("part")).alias("all"))
        near = F.slice(F.array_sort("all"), 1, k)
    x = x.select("image_id", "sp", "type", F.posexplode(near).alias("p", "v"))
    return x.select("image_id", "sp", "type", F.col("v.word").alias("word"), F.col("v.distance").alias("distance"), (F.col("p") + 1).alias("rank"))


def term_frequency(v: DataFrame) -> DataFrame:
    """tf of a word over all superpixels of the image."""
    return v.groupBy("image_id", "type", "word").agg(F.count("*").alias("tf"))


def vote_weight(weight: str, sigma: float = SIGMA) -> Column:
    return {"soft": vec.soft_weight(F.col("distance"), sigma), "index": F.col("word").cast("double"), "hard": F.lit(1.0)}[weight]


def strip_histograms(v: DataFrame, strips: DataFrame, weight: str = "soft", pooling: str | Callable[..., Column] = "mean") -> DataFrame:
    """image_id, type, strip, word, h: votes summed in each strip and band, pooled over the bands, divided by sqrt(tf).

    A pooling of one's own gets the bands' columns and gives one.
    """
    summed = strips.join(v, ["image_id", "sp"]).groupBy("image_id", "type", "strip", "band", "word").agg(F.sum(vote_weight(weight)).alias("s"))
    pivot = [F.coalesce(F.max(F.when(F.col("band") == b, F.col("s"))), F.lit(0.0)).alias(b) for b in ("low", "mid", "high")]
    wide = summed.groupBy("image_id", "type", "strip", "word").agg(*pivot)
    has = {r["band"] for r in strips.select("band").distinct().limit(4).collect()}
    cols = [F.col(b) for b in ("low", "mid", "high") if b in has] or [F.col("mid")]
    pooled = pooling(*cols) if callable(pooling) else {"mean": sum(cols[1:], cols[0]) / len(cols), "max": F.greatest(*cols) if len(cols) > 1 else cols[0], "min": F.least(*cols) if len(cols) > 1 else cols[0]}[pooling]
    x = wide.withColumn("h", pooled).join(term_frequency(v), ["image_id", "type", "word"])
    return x.select("image_id", "type", "strip", "word", (F.col("h") / F.sqrt(F.col("tf").cast("double"))).alias("h"))


def descriptor(hist: DataFrame, type_order: tuple[str, ...]) -> DataFrame:
    """Long descriptor (image_id, type, strip, word, v): all types and strips together, of length 1."""
    hist = hist.where(F.col("type").isin(*type_order))
    norms = hist.groupBy("image_id").agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("norm"))
    x = hist.join(norms, "image_id")
    return x.select("image_id", "type", "strip", "word", F.when(F.col("norm") == 0, F.lit(float("nan"))).otherwise(F.col("h") / F.col("norm")).alias("v"))


def dense_descriptor(hist: DataFrame, type_order: tuple[str, ...], n_strips: int, n_words: int) -> DataFrame:
    """image_id, x: the descriptor as an array, types in order, then strips, then words."""
    at = F.array_position(F.array(*map(F.lit, type_order)), F.col("type")).cast("int") - 1
    place = (at * n_strips + F.col("strip")) * n_words + F.col("word")
    cells = descriptor(hist, type_order).select("image_id", place.cast("int").alias("place"), "v")
    m = cells.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    n = len(type_order) * n_strips * n_words
    return m.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


