"""Retrieval quality: ranks, cumulative match curves, average precision, ROC."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..scratch import cut
from . import held, score
from .balance import Balanced
from .folds import Folded


def judged(scores: DataFrame) -> DataFrame:
    """scores with good (same person, other camera) and junk (same person and camera, or person -1)."""
    same, cam = F.col("gallery_person") == F.col("probe_person"), F.col("gallery_cam") == F.col("probe_cam")
    junk = (same & cam) | (F.col("gallery_person") == -1)
    return scores.withColumns({"good": same & ~cam & ~junk, "junk": junk})


def order_by(order: str) -> list[Column]:
    return [F.col("score").desc() if order == "best_first" else F.col("score").asc(), F.col("gallery_id").asc()]


def ranked(scores: DataFrame, order: str = "best_first") -> DataFrame:
    """judged rows without junk, with rk by probe."""
    w = Window.partitionBy("probe_id").orderBy(*order_by(order))
    return judged(scores).where(~F.col("junk")).withColumn("rk", F.row_number().over(w))


def average_precision(scores: DataFrame, order: str = "best_first") -> DataFrame:
    """probe_id, ap (null without a good row), first_hit: trapezoids between the precisions at hits and just before."""
    w = Window.partitionBy("probe_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    x = ranked(scores, order).withColumn("h", F.sum(F.col("good").cast("int")).over(w))
    before = F.when(F.col("rk") == 1, 1.0).otherwise((F.col("h") - 1) / (F.col("rk") - 1))
    part = F.when(F.col("good"), F.col("h") / F.col("rk") + before)
    n = F.sum(F.col("good").cast("int"))
    return x.groupBy("probe_id").agg((F.sum(part) / (2 * n)).alias("ap"), F.min(F.when(F.col("good"), F.col("rk"))).alias("first_hit"), n.cast("long").alias("n_good"))


#: Gallery rows that meet a probe at once.
ROWS = 2048


def precision(probes: DataFrame, gallery: DataFrame, measure, order: str = "best_first") -> DataFrame:
    """average_precision of the scores of probes and gallery(id, person, cam, x): each probe ranks the whole gallery in its task, and no score leaves it.

    The gallery goes along with the tasks; larger ones, repeated probes, missing values and such that aren't finite go by rows of scores.
    """
    names = ("id", "person", "cam", "x")
    p, g = probes.select(*names), gallery.select(*names)
    missing = lambda x: x.where(" or ".join(f"{c} is null" for c in names) + " or exists(x, v -> v is null or isnan(v) or abs(v) = double('inf'))").limit(1).count()
    told = p.agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).first()
    t = None if told["n"] > told["k"] or missing(p) or missing(g) else held.gathered(g, "id")
    if t is None:
        return average_precision(score.score(probes, gallery, measure), order)
    kernel, sign = score.KERNELS[measure], -1.0 if order == "best_first" else 1.0
    person, cam = (t.column(c).to_numpy() for c in ("person", "cam"))
    along = probes.sparkSession.sparkContext.broadcast((person, cam, held.cells(t)))
    del t

    def run(batches):
        person, cam, x = along.value
        known = person != -1
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                v = batch.column("x")[k].values.to_numpy()[None, :].astype(float)
                of, at = batch.column("person")[k].as_py(), batch.column("cam")[k].as_py()
                same = person == of
                ranked_ = np.flatnonzero(known & ~(same & (cam == at)))
                if not len(ranked_):
                    continue
                s = np.concatenate([kernel(x[i : i + ROWS], v)[:, 0] for i in range(0, len(x), ROWS)])[ranked_]
                rk = np.flatnonzero(same[ranked_][np.argsort(sign * s, kind="stable")]) + 1  # ties to the lower id
                n = len(rk)
                h = np.arange(1, n + 1)
                before = np.where(rk == 1, 1.0, (h - 1) / np.maximum(rk - 1, 1))
                out.append((batch.column("id")[k].as_py(), float((h / rk + before).sum() / (2 * n)) if n else None, int(rk[0]) if n else None, n))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], c) for i, c in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int64()))], names=["probe_id", "ap", "first_hit", "n_good"])

    dealt = p.repartition(8 * probes.sparkSession.sparkContext.defaultParallelism, "id")
    return dealt.mapInArrow(run, "probe_id long, ap double, first_hit int, n_good long")


def mean_average_precision(scores: DataFrame, order: str = "best_first") -> DataFrame:
    return mean_precision(average_precision(scores, order))


def mean_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"), F.count("ap").alias("n_queries"), F.avg(F.when(F.col("first_hit") == 1, 1.0).when(F.col("first_hit").isNotNull(), 0.0)).alias("rank1"))


def curve(first_hits: DataFrame, n: Column, max_rank: int) -> DataFrame:
    """rank, rate: share of n with first_hit up to the rank, for ranks 1 .. max_rank."""
    counts = first_hits.where(F.col("first_hit") <= max_rank).groupBy(F.col("first_hit").cast("long").alias("rank")).agg(F.count("*").alias("c"))
    ranks = first_hits.sparkSession.range(1, max_rank + 1).select(F.col("id").alias("rank"))
    total = first_hits.agg(n.alias("n")).first()["n"]
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = ranks.join(counts, "rank", "left").withColumn("c", F.sum(F.coalesce("c", F.lit(0))).over(w))
    return x.select("rank", (F.col("c") / F.lit(total or 1)).alias("rate"))


def market_cmc(scores: DataFrame, max_rank: int, order: str = "best_first") -> DataFrame:
    return precision_curve(average_precision(scores, order), max_rank)


def precision_curve(ap: DataFrame, max_rank: int) -> DataFrame:
    return curve(ap.where("n_good > 0"), F.count("*"), max_rank)


def rank1_skip_same_camera(scores: DataFrame, order: str = "best_first") -> DataFrame:
    """probe_id, hit: whether the best row that isn't the same person under the same camera is the person."""
    x = scores.where(~((F.col("gallery_person") == F.col("probe_person")) & (F.col("gallery_cam") == F.col("probe_cam"))))
    best = F.min_by(F.col("gallery_person"), F.struct(F.when(F.lit(order == "best_first"), -F.col("score")).otherwise(F.col("score")), F.col("gallery_id")))
    return x.groupBy("probe_id", "probe_person").agg(best.alias("p")).select("probe_id", (F.col("p") == F.col("probe_person")).alias("hit"))


def optimistic_ranks(scores: DataFrame, by: str) -> DataFrame:
    """trial, key, r: 1 + number of strictly greater scores than the true match's, by rows or columns of the score matrix."""
    w = Window.partitionBy("trial", by).orderBy(F.col("score").desc())
    return scores.withColumn("r", F.rank().over(w)).where("match").select("trial", F.col(by).alias("key"), "r")


def symmetric_cmc(scores: DataFrame, max_rank: int) -> DataFrame:
    """rank, rate of scores(trial, probe, gallery, match, score): both directions, averaged over trials."""
    both = optimistic_ranks(scores, "probe").unionByName(optimistic_ranks(scores, "gallery"))
    return curve(both.withColumnRenamed("r", "first_hit"), F.count("*"), max_rank)


def first_match(scores: DataFrame, by: tuple[str, ...], tie: str, largest: bool = False) -> DataFrame:
    """by, first_hit: place of the first match when rows of `by` are sorted by score, then tie; of the best match if there are several."""
    order = F.col("score").desc() if largest else F.col("score").asc()
    w = Window.partitionBy(*by).orderBy(order, F.col(tie))
    return scores.withColumn("rk", F.row_number().over(w)).where("match").groupBy(*by).agg(F.min("rk").alias("first_hit"))


def euclid_cmc(scores: DataFrame, max_rank: int) -> DataFrame:
    """rank, rate of distances(trial, probe, gallery, match, score): by probe and by gallery row, over both."""
    rows = first_match(scores, ("trial", "probe"), "gallery").select("trial", F.col("probe").alias("key"), "first_hit")
    cols = first_match(scores, ("trial", "gallery"), "probe").select("trial", F.col("gallery").alias("key"), "first_hit")
    return curve(rows.unionByName(cols), F.count("*"), max_rank)


def closed_set_cmc(scores: DataFrame, n_ranks: int) -> DataFrame:
    """rank, rate of similarities; every probe must have a gallery match."""
    hits = first_match(scores, ("probe",), "gallery", largest=True)
    missing = scores.select("probe").distinct().join(hits, "probe", "left_anti")
    if missing.limit(1).count():
        raise ValueError("a probe has no match in the gallery")
    return curve(hits, F.count("*"), n_ranks)


def closed_set_curve(probes: DataFrame, gallery: DataFrame, n_ranks: int) -> DataFrame:
    """closed_set_cmc of the dot products of probes and gallery(id, person, x); scores are counted in their blocks, and none is sorted."""
    best = cut(score.best_match(probes.select("id", "person", "x"), gallery, vec.dot))
    if gallery.limit(1).count() and best.count() < probes.count():
        raise ValueError("a probe has no match in the gallery")
    return curve(score.ahead(best, gallery, vec.dot, largest=True), F.count("*"), n_ranks)


def sides_curve(a: DataFrame, b: DataFrame, measure, max_rank: int, largest: bool = False, ties: bool = True) -> DataFrame:
    """rank, rate of a and b(trial, id, x), where equal ids match: both directions over all trials, scores counted in their blocks.

    Without ties as symmetric_cmc (largest) has it, with ties as euclid_cmc.
    """
    a, b = a.where("id is not null"), b.where("id is not null")
    hits = score.ahead(*score.matched(a, b, measure, ("trial",)), measure, ("trial",), largest, ties)
    return curve(cut(hits), F.count("*"), max_rank)


def matching_cmc(pairs: DataFrame, max_rank: int) -> DataFrame:
    """rank, rate of paired samples: the partner is the match."""
    return curve(first_match(pairs, ("probe",), "gallery"), F.count("*"), max_rank)


#: Ranges of distances from one power of two to the next.
RANGES = 1024


def with_part(scored: DataFrame) -> DataFrame:
    """scored with __part, a range of distances; it rises with the distance, however these lie, so no pass is needed to find it."""
    d = F.col("distance")
    at = lambda c: F.floor(F.log2(c) * RANGES) + 1100 * RANGES
    part = F.when(d > 0, at(d)).when(d < 0, -at(-d)).when(d == 0, 0)
    return scored.withColumn("__part", F.when(F.isnan("distance"), F.lit(2**62)).otherwise(F.coalesce(part, F.lit(2**62))))


def sums_by_part(scored: DataFrame | Balanced | Folded, *by: str) -> DataFrame:
    """by, __part, with counts sp, sq in it, bp, bq before it, and np, nq of all."""
    if isinstance(scored, (Balanced, Folded)):
        sums = scored.sums()
    else:
        sums = with_part(scored).groupBy(*by, "__part").agg(F.sum(F.col("match").cast("int")).alias("sp"), F.sum((~F.col("match")).cast("int")).alias("sq"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return sums.select(*by, "__part", "sp", "sq", so_far("sp").alias("bp"), so_far("sq").alias("bq"), F.sum("sp").over(whole).alias("np"), F.sum("sq").over(whole).alias("nq"))


def rate(a: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), n), F.lit(0.0))


def accumulated(scored: DataFrame, *by: str, starts: DataFrame | None = None) -> DataFrame:
    """by, k, tpr, fpr of scored(by, key, distance, match) by rising distance: equal distances in the order of keys; with starts only for its ranges.

    Counts are accumulated over ranges of distance first and inside a range then, so no task sorts all rows, nor all of a fold.
    """
    starts = sums_by_part(scored, *by) if starts is None else starts
    x = (scored if "__part" in scored.columns else with_part(scored)).withColumns({"p": F.col("match").cast("int"), "q": (~F.col("match")).cast("int")})
    w = Window.partitionBy(*by, "__part").orderBy("distance", "key").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(starts.select(*by, "__part", "bp", "bq", "np", "nq"), [*by, "__part"])
    x = x.select(*by, "np", "nq", (F.col("bp") + F.sum("p").over(w)).alias("tp"), (F.col("bq") + F.sum("q").over(w)).alias("fp"))
    return x.select(*by, (F.col("tp") + F.col("fp")).alias("k"), rate(F.col("tp"), F.col("np")).alias("tpr"), rate(F.col("fp"), F.col("nq")).alias("fpr"))


def crossing(scored: DataFrame | Balanced | Folded, *by: str) -> DataFrame:
    """equal_error of the accumulated rows, from (0, 0) on without by: only ranges in which tpr and 1 - fpr can be nearest are sorted.

    tpr + fpr never falls, so a range's ends tell what lies inside. scored is computed twice instead of stored.
    """
    starts = cut(sums_by_part(scored, *by))
    c = F.col
    gap = lambda p, q: rate(p, c("np")) + rate(q, c("nq")) - 1
    ends = starts.withColumns({"__lo": gap(c("bp"), c("bq")), "__hi": gap(c("bp") + c("sp"), c("bq") + c("sq"))})
    least = F.min(F.abs("__hi")).over(Window.partitionBy(*by)) + F.lit(2e-9)
    open_ = ends.withColumn("__least", least).where("__lo <= __least and __hi >= -__least").select(starts.columns)
    points = accumulated(scored.rows(open_.select(F.col("fold") if by else F.lit(0).alias("fold"), "__part")) if isinstance(scored, (Balanced, Folded)) else scored, *by, starts=F.broadcast(open_))
    return equal_error(points if by else points.unionByName(zero(starts.sparkSession)), *by)


def zero(spark) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))


def roc(scored: DataFrame | Balanced) -> DataFrame:
    """k, tpr, fpr of scored(key, distance, match) by falling similarity, from (0, 0) on."""
    if isinstance(scored, Balanced):
        points = scored.roc()
        points = accumulated(scored.rows().drop("__part")) if points is None else points
    else:
        points = accumulated(scored)
    return points.unionByName(zero(points.sparkSession))


def equal_error(points: DataFrame, *by: str) -> DataFrame:
    """eer: the error where tpr and 1 - fpr are nearest; the first such point."""
    gap = F.abs(F.col("tpr") - (1 - F.col("fpr")))
    return points.groupBy(*by).agg(F.min_by(F.col("fpr"), F.struct(F.round(gap, 9), F.col("k"))).alias("eer"))


def fold_errors(scored: DataFrame | Balanced | Folded) -> DataFrame:
    """fold, eer of scored(fold, key, distance, match)."""
    return crossing(scored, "fold")


def error_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("eer").alias("mean_eer"), F.stddev_samp("eer").alias("std_eer"), (F.stddev_samp("eer") / F.sqrt(F.count("*").cast("double"))).alias("stderr_eer"))
