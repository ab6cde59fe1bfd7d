"""Pairs of samples(id, person, cam, x): positives, drawn negatives, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from . import draws
from .order import numbered


def named(df: DataFrame, suffix: str, columns: tuple[str, ...] = ("id", "person", "cam", "x")) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{suffix}") for c in columns if c in df.columns])


def positives(samples: DataFrame, both_ways: bool = False) -> DataFrame:
    """Pairs of one person under different cameras; each pair once (smaller id first) or in both directions."""
    a, b = named(samples, "a"), named(samples, "b")
    on = (F.col("person_a") == F.col("person_b")) & (F.col("cam_a") != F.col("cam_b"))
    return a.join(b, on if both_ways else on & (F.col("id_a") < F.col("id_b")))


#: Draws are mixed modulo this prime.
PRIME = 2_147_483_647


def mixed(i: Column, k: Column, seed: int) -> Column:
    """A number under PRIME for row i and turn k: squared twice on the way, so draws have no short period."""
    i = F.pmod(i, F.lit(PRIME)).cast("long")
    t = F.pmod(i * 1103515 + k * 104729 + F.lit(seed * 7919 + 12345), F.lit(PRIME))
    t = F.pmod(t * t + i, F.lit(PRIME))
    t = F.pmod(t * 48271 + 11, F.lit(PRIME))
    return F.pmod(t * t, F.lit(PRIME))


def draw(i: Column, k: Column, n: Column, seed: int = 17) -> Column:
    """Deterministic draw k of row i out of 0 .. n - 1."""
    return F.pmod(mixed(i, k, seed), n)


def indexed(samples: DataFrame) -> DataFrame:
    """samples with idx 0, 1, ... in the order of ids: counts of id ranges are accumulated, then places inside a range."""
    span = F.floor(F.col("id") / 4096)
    x = samples.withColumn("__span", span)
    sizes = x.groupBy("__span").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__span", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__span").orderBy("id")) - 1
    return x.join(starts, "__span").withColumn("idx", (F.col("__before") + inside).cast("long")).drop("__span", "__before")


def negatives(samples: DataFrame, draws: int = 5) -> DataFrame:
    """Drawn partners of another person under another camera, with the number of the draw."""
    x = indexed(samples)
    n = samples.count()
    a = named(x, "a", ("id", "person", "cam", "x", "idx")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    a = a.withColumn("idx_b", draw(F.col("idx_a"), F.col("draw"), F.lit(n)))
    b = named(x, "b", ("id", "person", "cam", "x", "idx"))
    return a.join(b, "idx_b").where("person_a <> person_b and cam_a <> cam_b").drop("idx_a", "idx_b")


def drawn_negatives(samples: DataFrame, n_draws: int) -> DataFrame:
    """d, id_a, id_b: distinct pairs of different persons under different cameras, smaller id first, with their first draw."""
    n = samples.count()
    x = indexed(samples).select("id", "person", "cam", "idx")
    d = samples.sparkSession.range(n_draws).select(F.col("id").alias("d"))
    d = d.select("d", draw(F.col("d"), F.lit(1), F.lit(n), 3).alias("ia"), draw(F.col("d"), F.lit(2), F.lit(n), 11).alias("ib"))
    a = named(x, "a", ("id", "person", "cam", "idx")).withColumnRenamed("idx_a", "ia")
    b = named(x, "b", ("id", "person", "cam", "idx")).withColumnRenamed("idx_b", "ib")
    pairs = d.join(a, "ia").join(b, "ib").where("person_a <> person_b and cam_a <> cam_b")
    return pairs.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.min("d").alias("d"))


def negatives_there(samples: DataFrame) -> int:
    """How many pairs of different persons under different cameras there are, from counts."""
    n = samples.groupBy("person", "cam").agg(F.count("*").alias("n"))
    square = lambda *by: n.groupBy(*by).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
    return (square() - square("person") - square("cam") + square("person", "cam")) // 2


def balanced(samples: DataFrame) -> DataFrame:
    """Distinct drawn negatives, in the order of their first draws, as many as there are positives (or all, where there are fewer); match tells them apart.

    The number of draws is doubled until there are enough; which pairs come first does not depend on it.
    """
    there = negatives_there(samples)
    packed = draws.balanced(samples, there)
    if packed is not None:
        return packed
    pos = positives(samples).select("id_a", "id_b", F.lit(True).alias("match"))
    wanted = min(pos.count(), there)
    n_draws = 4 * wanted + 1024
    neg = cut(drawn_negatives(samples, n_draws))
    while neg.count() < wanted:
        n_draws *= 2
        neg = cut(drawn_negatives(samples, n_draws))
    first = indexed(neg.select(F.col("d").alias("id"), "id_a", "id_b")).where(F.col("idx") < wanted)
    return pos.unionByName(first.select("id_a", "id_b", F.lit(False).alias("match")))


def exhaustive_negatives(samples: DataFrame) -> DataFrame:
    """All pairs of different persons under different cameras, smaller id first; a stated full comparison."""
    a, b = named(samples, "a"), named(samples, "b")
    return a.join(b, (F.col("cam_a") != F.col("cam_b")) & (F.col("person_a") != F.col("person_b")) & (F.col("id_a") < F.col("id_b")))


def label_constraints(samples: DataFrame, count: int, lower: float, upper: float) -> DataFrame:
    """i, j, sign, bound of drawn pairs: +1 and the lower bound for one person, else -1 and the upper."""
    n = samples.count()
    x = indexed(samples).select("id", "person", "idx")
    d = samples.sparkSession.range(count).select(F.col("id").alias("c"))
    d = d.select("c", draw(F.col("c"), F.lit(5), F.lit(n), 1).alias("ia"), draw(F.col("c"), F.lit(7), F.lit(n), 2).alias("ib"))
    a = x.select(F.col("idx").alias("ia"), F.col("id").alias("i"), F.col("person").alias("pa"))
    b = x.select(F.col("idx").alias("ib"), F.col("id").alias("j"), F.col("person").alias("pb"))
    same = F.col("pa") == F.col("pb")
    return d.join(a, "ia").join(b, "ib").select("c", "i", "j", F.when(same, 1).otherwise(-1).alias("sign"), F.when(same, F.lit(lower)).otherwise(F.lit(upper)).alias("bound"))


def pair_constraints(pairs: DataFrame, lower: float, upper: float) -> DataFrame:
    return pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.when(F.col("match"), 1).otherwise(-1).alias("sign"), F.when(F.col("match"), F.lit(lower)).otherwise(F.lit(upper)).alias("bound"))


def instances(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct (person, id) that stand in any pair."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    return ids.join(samples.select("id", "person"), "id").select("person", "id")


def balanced_instances(samples: DataFrame) -> DataFrame:
    """instances(balanced(samples), samples); no pair is made where cameras by person tell that every row has a positive. Rows that repeat an id or stand alone need the pairs."""
    known = samples.where("id is not null and person is not null and cam is not null").select("id", "person", "cam")
    several = known.groupBy("person").agg(F.min("cam").alias("low"), F.max("cam").alias("high")).where("low < high").select("person")
    n = samples.agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids")).first()
    if n["rows"] > n["ids"] or known.join(several, "person", "left_anti").limit(1).count():
        return instances(balanced(samples), samples)
    return known.select("person", "id")


def pair_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def sample_every(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every n-th row in an order, from the first: a sampling operator."""
    return numbered(df, order, name="__rn").where(F.col("__rn") % n == 1).drop("__rn")


def half_split(samples: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """samples with test: a fixed shuffle of the keys, of which the first half of the range is the test."""
    return samples.withColumn("test", mixed(F.col(key), F.lit(0), seed) < PRIME // 2)


def consecutive_labels(df: DataFrame, label: str) -> DataFrame:
    """df with the label's place among the sorted distinct labels, from 0."""
    places = numbered(df.select(label).distinct(), label, name="place").withColumn("place", F.col("place") - 1)
    return df.join(places, label)


def paired_classes(pairs: DataFrame) -> DataFrame:
    """id, person, x: every matching pair as a class of two points."""
    x = numbered(pairs.where("match"), "id_a", "id_b", name="person").withColumn("person", F.col("person") - 1)
    two = F.explode(F.array(F.struct(F.col("x_a").alias("x"), F.lit(0).alias("k")), F.struct(F.col("x_b").alias("x"), F.lit(1).alias("k"))))
    return x.select("person", two.alias("p")).select((F.col("person") * 2 + F.col("p.k")).cast("long").alias("id"), "person", "p.x")
