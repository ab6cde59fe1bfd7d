"""Expressions that the native operators share: words, lines, bindings and joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: A table of at most so many rows may be broadcast.
BROADCAST_ROWS = 50_000
SALTS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE))


def key_of(column: Column) -> Column:
    """A string that tells null from every value, for joins that must keep null as a key."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def join_small(big: DataFrame, small: DataFrame, key: str, n_small: int, spread: Column) -> DataFrame:
    """Left join of big with small, one row a key. Broadcast up to BROADCAST_ROWS rows;
    beyond, every key is dealt over SALTS partitions by spread, so a hot key is split."""
    if n_small <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "__salt"], "left").drop("__salt")
