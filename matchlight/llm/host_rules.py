"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets rule figures over its whole text. Failures are aggregated by
host (the column source), each host's failure rate is shrunk towards the others with
a beta prior fitted to the hosts' rates by moments, and the host verdicts are joined
back: a document is kept if it fails no rule of its own and its host's shrunk rate is
under HOST_LIMIT.

Null and empty texts have no words and fail. Texts are taken whole, of any length; the
figures are long integers. A null host is a host of its own. Rows that repeat count as
rows. A shrunk rate that ties with HOST_LIMIT rejects the host. Extra columns stay; the
operator's own columns begin with two underscores inside and are named on return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .native import SPACE, join_small, key_of, let, words, worded_lines

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A text with a symbol for every so many words, or fewer, fails.
WORDS_PER_SYMBOL = 4
SYMBOLS = "#*$%&|<>"
#: A text of which more words than this equal the word before fails.
STUTTER_PERCENT = 30
#: Hosts with a shrunk failure rate of this or more are rejected whole.
HOST_LIMIT = 0.5
#: Strength of the prior where the hosts' rates do not vary or there is one host only.
FLAT_STRENGTH = 100.0


def repeated_words(tokens: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the text.

    Windows are compared by 64-bit hashes. Most texts have no repeated window, which
    the count of distinct hashes tells; the others sort (hash, place) pairs.
    """
    n = F.size(tokens)
    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    )

    def places(pairs: Column) -> Column:
        same = lambda z, other: F.coalesce(F.get(pairs, other)["h"] == z["h"], F.lit(False))
        twice = F.filter(pairs, lambda z, k: same(z, k - 1) | same(z, k + 1))
        return F.sort_array(F.transform(twice, lambda z: z["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, places), covered))

    return let(hashes, count)


def figures(text: Column) -> Column:
    """A struct of the rule figures of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(tokens: Column) -> Column:
        stutter = F.size(F.filter(tokens, lambda w, i: F.coalesce(F.get(tokens, i - 1) == w, F.lit(False))))
        return F.struct(F.size(tokens).cast("long").alias("n_words"), repeated_words(tokens).cast("long").alias("n_repeat_words"), stutter.cast("long").alias("n_stutter"))

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    return F.struct(
        let(words(text), of_words).alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(worded_lines(text), of_lines).alias("n_dup_lines"),
    )


def rated(docs: DataFrame, text: str = "text", host: str = "source", columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named) with the struct __q (figures, base_failed, failed) and the host's key __host; computed once."""
    x = docs.withColumn("__q", figures(F.col(text))).withColumn("__host", key_of(F.col(host)))
    x = x.select(*(docs.columns if columns is None else columns), "__q", "__host")
    w = F.col("__q.w")
    base = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > REPEAT_PERCENT * w["n_words"])
    symbols = WORDS_PER_SYMBOL * F.col("__q.n_symbols") > w["n_words"]
    stutter = 100 * w["n_stutter"] > STUTTER_PERCENT * w["n_words"]
    q = F.struct(
        w["n_words"].alias("n_words"), F.col("__q.word_chars").alias("word_chars"), F.col("__q.n_symbols").alias("n_symbols"),
        F.col("__q.n_dup_lines").alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), base.alias("base_failed"), (base | symbols | stutter).alias("failed"),
    )
    return cut(x.withColumn("__q", q))


def host_verdicts(rows: DataFrame) -> tuple[DataFrame, int]:
    """__host and __bad of every host, and the number of hosts."""
    hosts = cut(rows.groupBy("__host").agg(F.count("*").alias("n"), F.sum(F.col("__q.failed").cast("long")).alias("f")))
    rate = F.col("f") / F.col("n")
    seen = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    alpha, beta = prior(seen["m"], seen["v"])
    shrunk = (F.col("f") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.select("__host", (shrunk >= HOST_LIMIT).alias("__bad")), seen["k"]


def prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters by moments of the hosts' rates."""
    if mean is None:
        return 1.0, 1.0
    strength = mean * (1 - mean) / variance - 1 if variance and variance > 0 else FLAT_STRENGTH
    strength = max(strength, 1e-3)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, text: str = "text", host: str = "source", columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those named) with __q and __kept."""
    rows = rated(docs, text, host, columns)
    hosts, n = host_verdicts(rows)
    found = join_small(rows, hosts, "__host", n, F.struct(*[c for c in rows.columns if c == "doc_id"], F.col("__q.n_words"), F.col("__q.word_chars")))
    return found.withColumn("__kept", ~F.col("__q.failed") & ~F.col("__bad")).drop("__host", "__bad")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the figures, base_failed and kept of every document."""
    return judged(docs.select("doc_id", "text", "source"), columns=["doc_id"]).select("doc_id", "__q.*", F.col("__kept").alias("kept")).drop("failed")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judged(docs).where("__kept").select(*docs.columns)
