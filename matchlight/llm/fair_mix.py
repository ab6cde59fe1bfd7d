"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's queue twice (two epochs) in an order shuffled by
a hash of its id. The virtual finish time of a copy is the running number of its
source's words up to its end, divided by the source's target; copies are taken in the
order of their virtual time until the total budget is full.

Running sums never put a source in one task: a source of n documents is cut into about
sqrt(n) ranges of the hash, sums of ranges are accumulated over ranges, and documents
inside their range; the global order is cut the same way in ranges of virtual time.

Null and empty texts have size 0 and are never short of room. A null source is a source
of its own, last in order. Rows that repeat an id share their place in the queue and
each counts; rows without an id share one place, end at one virtual time, and are taken
or left together. Ties of virtual time go by source, epoch, place and id. Texts are
counted whole, of any length. Extra columns stay in ``mixed``. Without words all targets
are 0. One task orders the sources for their targets: it sees a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .native import NOT_SPACE, join_small, key_of

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Budget as a share of all words, and the most a source may give as a multiple of its own.
BUDGET, EPOCHS = 1.5, 2
SEED = 20_011
HASH_BITS = 53


def place(doc_id: Column) -> Column:
    """The document's place in the shuffled order, 0 to 2**HASH_BITS."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id), 64 - HASH_BITS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, __key, __size and __u of every document; computed once."""
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")
    return cut(docs.select("doc_id", "source", key_of(F.col("source")).alias("__key"), size.alias("__size"), place(F.col("doc_id")).alias("__u")))


def targets(rows: DataFrame) -> DataFrame:
    """A row a source: __key, __sum (its words), __n, __target and __ranges. One task orders them: it sees a row a source."""
    sources = rows.groupBy("__key").agg(F.sum("__size").alias("__sum"), F.count("*").alias("__n"))
    last_null = F.col("__key") == ""
    ranked = sources.withColumn("__w", F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(last_null, "__key")) - 1) % len(WEIGHTS)).cast("int")))
    cap = F.col("__sum") * EPOCHS
    order = Window.orderBy(F.col("__r"), "__key")
    x = ranked.withColumn("__r", cap / F.col("__w"))
    all_rows = Window.partitionBy()
    x = x.withColumns(
        {
            "__total": F.sum("__sum").over(all_rows) * F.lit(BUDGET),
            "__capped": F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "__left": F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("__total") - F.coalesce("__capped", F.lit(0))) / F.col("__left")
    x = x.withColumn("__level", level)
    x = x.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__r", "__key", "__level"))).over(all_rows)["__level"])
    target = F.least(cap.cast("double"), F.col("__w") * F.col("__level"))
    return x.select("__key", "__sum", "__n", F.coalesce(target, cap.cast("double")).alias("__target"), F.ceil(F.sqrt(F.col("__n").cast("double"))).alias("__ranges"))


def queued(rows: DataFrame) -> DataFrame:
    """rows with the source's figures and __v0, __v1: virtual finish times of the two copies; computed once."""
    sources = cut(targets(rows))
    x = join_small(rows, sources, "__key", sources.count(), F.col("__u"))
    x = x.withColumn("__range", F.floor(F.col("__u") / F.lit(2.0**HASH_BITS) * F.col("__ranges")))
    ranges = x.groupBy("__key", "__range").agg(F.sum("__size").alias("__in"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__key", "__range", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"))
    x = x.join(ranges, ["__key", "__range"])
    inside = Window.partitionBy("__key", "__range").orderBy("__u", "doc_id")  # rows of one place end together
    x = x.withColumn("__cum", F.col("__before") + F.sum("__size").over(inside))
    time = lambda c: F.when(F.col("__target") > 0, c / F.col("__target")).otherwise(F.lit(0.0))
    x = x.withColumns({"__v0": time(F.col("__cum")), "__v1": time(F.col("__cum") + F.col("__sum"))})
    return cut(x.select(*rows.columns, "__sum", "__target", "__v0", "__v1"))


def copy_order(epoch: int) -> Column:
    """What copies are ordered by, over all sources."""
    return F.struct(F.col(f"__v{epoch}").alias("v"), F.col("__key").alias("k"), F.lit(epoch).alias("e"), F.col("__u").alias("u"), F.col("doc_id").alias("d"))


def last_taken(q: DataFrame) -> Column:
    """The last copy that still fits the budget, as a literal; null if there is none."""
    total = q.agg(F.sum("__size").alias("s"), F.count("*").alias("n")).first()
    if not total["n"]:
        return F.lit(None)
    budget = int(BUDGET * total["s"])
    slots = max(1, int(total["n"] ** 0.5))
    copies = q.select("__size", F.explode(F.array(copy_order(0), copy_order(1))).alias("__c"))
    copies = copies.withColumn("__slot", F.floor(F.least(F.col("__c.v"), F.lit(float(EPOCHS))) * slots))
    sums = copies.groupBy("__slot").agg(F.sum("__size").alias("s"))
    running = sums.withColumn("run", F.sum("s").over(Window.orderBy("__slot")))
    full = running.where(F.col("run") > budget).orderBy("__slot").select("__slot", (F.col("run") - F.col("s")).alias("before")).first()
    if full is None:
        best = copies.agg(F.max("__c").alias("c")).first()["c"]
    else:
        here = copies.where(F.col("__slot") == full["__slot"])
        within = here.withColumn("run", F.sum("__size").over(Window.orderBy("__c")) + full["before"]).where(F.col("run") <= budget)
        best = within.agg(F.max("__c").alias("c")).first()["c"]
        if best is None:
            best = copies.where(F.col("__slot") < full["__slot"]).agg(F.max("__c").alias("c")).first()["c"]
    if best is None:
        return F.lit(None)
    kind = q.schema["doc_id"].dataType
    return F.struct(F.lit(best["v"]).alias("v"), F.lit(best["k"]).alias("k"), F.lit(best["e"]).alias("e"), F.lit(best["u"]).alias("u"), F.lit(best["d"]).cast(kind).alias("d"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    q = queued(sized(docs))
    last = last_taken(q)
    copies = sum((F.when(copy_order(e) <= last, 1).otherwise(0) for e in range(EPOCHS)), F.lit(0))
    return q.select("doc_id", F.col("__size").alias("size"), F.col("__sum").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * copies).alias("taken"), copies.cast("long").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with their columns, each as often as it is taken.

    Virtual time grows along a source's queue, so a source's last taken copy tells
    what is taken of it; the texts themselves are never shuffled.
    """
    q = queued(sized(docs))
    last = last_taken(q)
    copies = q.select("__key", F.explode(F.array(copy_order(0), copy_order(1))).alias("c")).where(F.col("c") <= last)
    ends = cut(copies.groupBy("__key").agg(F.max(F.struct("c.e", "c.u", "c.d")).alias("__end")))
    x = docs.withColumn("__key", key_of(F.col("source"))).withColumn("__u", place(F.col("doc_id")))
    x = join_small(x, ends, "__key", ends.count(), F.col("__u"))
    at = lambda e: F.struct(F.lit(e).alias("e"), F.col("__u").alias("u"), F.col("doc_id").alias("d"))
    n = sum((F.when(at(e) <= F.col("__end"), 1).otherwise(0) for e in range(EPOCHS)), F.lit(0))
    return x.withColumn("__n", n).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
