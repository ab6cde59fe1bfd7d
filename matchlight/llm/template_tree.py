"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line goes down the tree by its number of tokens and its leading token, with tokens
that hold a digit read as a variable. At the leaf the places are dealt in GROUPS groups,
and a long line stands for one template for each half of the groups, in which the places
of the other half are generalised to variables: lines that differ in any GROUPS / 2
fields meet under a template, and what they agree in is half the line at least. A short
line, or one with hardly any constant token, stands for itself. A template found in
MIN_DOCS documents or more recurs, and all lines under it are dropped but the first in
the corpus (smallest doc_id, then place).

Null and empty texts have no lines and stay. Texts and lines may be of any length. A
document of which no line is left goes in ``dedup``; ``lines_report`` tells it with all
rows. Rows that repeat a doc_id are one document, whose places are those of all its rows
(they keep equal lines if their texts are equal). Rows without an id count as one
document and keep all their lines. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .native import NOT_SPACE, SPACE, let

MIN_DOCS = 5
#: Tokens after the count that lead down the tree.
DEPTH = 1
#: Groups of places, by place modulo their number; half of them are kept in a template.
GROUPS = 4
KEPT = tuple(combinations(range(GROUPS), GROUPS // 2))
#: Lines of fewer tokens are not generalised beyond their variables.
MIN_TOKENS = 8
VARIABLE = "<*>"


def templates(line: Column) -> Column:
    """Hashes of the templates that a line falls under: one for each of KEPT, or one for short or all-variable lines."""
    tokens = F.filter(F.split(line, SPACE, -1), lambda t: t != "")
    mask = lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t)

    def at(g: int) -> Callable[[Column, Column], Column]:
        return lambda t, i: i % GROUPS == g

    def of_groups(groups: Column, n: Column, lead: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(k), n, lead, *[F.get(groups, F.lit(g)) for g in kept]) for k, kept in enumerate(KEPT)])

    def of_masked(masked: Column, raw: Column) -> Column:
        n = F.size(masked)
        variables = F.size(F.filter(masked, lambda t: t == VARIABLE))
        groups = F.array(*[F.xxhash64(F.filter(masked, at(g))) for g in range(GROUPS)])
        return (
            F.when(2 * variables > n, F.array(F.xxhash64(F.lit("line"), raw)))
            .when(n < MIN_TOKENS, F.array(F.xxhash64(F.lit("short"), masked)))
            .otherwise(let(groups, lambda x: of_groups(x, n, F.slice(masked, 1, DEPTH))))
        )

    return let(tokens, lambda raw: let(F.transform(raw, mask), lambda masked: of_masked(masked, raw)))


def places(docs: DataFrame) -> DataFrame:
    """doc_id, place and templates of every line with a word, a row for each template; computed once, and kept with a row a line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("__place", "__line")).where(F.col("__line").rlike(NOT_SPACE))
    lines = cut(lines.select("doc_id", "__place", templates(F.col("__line")).alias("__templates")))
    return lines.select("doc_id", "__place", F.explode("__templates").alias("__template"))


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id and the places of its lines to drop, for documents that have any."""
    found = places(docs.select("doc_id", "text"))
    often = cut(found.groupBy("__template").agg(F.count("*").alias("__n")).where(F.col("__n") >= MIN_DOCS).select("__template"))  # rows first: most templates have one
    found = cut(found.join(often, "__template"))
    by_doc = found.groupBy("__template", "doc_id").agg(F.min("__place").alias("__place"))
    recurring = by_doc.groupBy("__template").agg(F.count("*").alias("__n"), F.min(F.struct("doc_id", "__place")).alias("__first")).where(F.col("__n") >= MIN_DOCS)
    recurring = cut(recurring.select("__template", "__first"))  # else the join stands in the aggregate's stage, where a hot template can't be split
    again = found.join(recurring, "__template").where(F.struct("doc_id", "__place") != F.col("__first"))
    return again.groupBy("doc_id").agg(F.collect_set("__place").alias("__drop"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with __text (what is left), __n_lines (lines with a word) and __n_dropped."""
    x = docs.join(dropped(docs).withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").drop("__id")

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), left))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: line.rlike(NOT_SPACE)))
    n_dropped = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop"))
    return x.withColumns({"__text": text, "__n_lines": n_lines.cast("long"), "__n_dropped": n_dropped.cast("long")}).drop("__drop")


def lines_report(docs: DataFrame) -> DataFrame:
    """doc_id, lines with a word, lines dropped and the hash of what is left of every document."""
    x = cleaned(docs.select("doc_id", "text"))
    digest = F.sha2(F.coalesce("__text", F.lit("")).cast("binary"), 256)
    return x.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines cut from their texts, n_chars (if there) set anew; documents of which nothing is left go."""
    x = cleaned(docs).where((F.col("__n_dropped") == 0) | (F.col("__n_dropped") < F.col("__n_lines")))
    columns = {"text": F.col("__text").alias("text"), "n_chars": F.when(F.col("__n_dropped") == 0, F.col("n_chars")).otherwise(F.length("__text")).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars") if "n_chars" in docs.columns else None}
    return x.select(*[columns.get(c, F.col(c)) for c in docs.columns])
