"""Balanced pairs with their distances, made anew in the tasks by each pass over them: no pair is stored, and a sort sends each as the gap to the one before.

Positives are blocks of classes, negatives are draws; a place in a block or a draw tells the pair, and the vectors go along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import draws, held

#: A pair's key is id_a * KEY + id_b.
KEY = 1_000_003
#: Blocks of positives in a piece, rows in a batch, pairs in a range that one task sorts.
PIECE, ROWS, RANGE = 16, 1 << 16, 1 << 20
#: Bins of distances: so many bits of the fraction, from 2^-LOW on; what lies beyond either end is in the last bin there.
BITS, LOW, OCTAVES = 12, 30, 60
BINS = OCTAVES << BITS


def bins(distance: np.ndarray) -> np.ndarray:
    """They rise with the distance, which is at least 0."""
    return np.clip((distance.view(np.int64) >> (52 - BITS)) - ((1023 - LOW) << BITS), 0, BINS - 1)


class Rows(draws.Held):
    """What the tasks hold: also vectors by cell, and blocks of positives."""

    def __init__(self, samples: DataFrame, t: pa.Table):
        super().__init__(samples)
        self.cells = np.ascontiguousarray(held.cells(t).T)
        self.order, self.blocks = held.class_blocks(self.whole, self.person, self.cam)
        self.last = -1

    def drawn(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = draws.codes(self, d)
        return code // self.n, code % self.n

    def placed(self, piece: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks = np.array(self.blocks[piece * PIECE : (piece + 1) * PIECE])
        ends = np.cumsum((blocks[:, 1] - blocks[:, 0]) * (blocks[:, 3] - blocks[:, 2]))
        k = np.searchsorted(ends, at, side="right")
        inside, width = at - np.append(0, ends)[k], (blocks[:, 3] - blocks[:, 2])[k]
        return self.order[blocks[k, 0] + inside // width], self.order[blocks[k, 2] + inside % width]

    def between(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        """Euclidean distances, squares added in order."""
        out = np.empty(len(ia))
        for k in range(0, len(ia), ROWS):
            order = np.argsort(ib[k : k + ROWS])  # near rows on both sides, as a is near in a bucket of draws
            a, b = ia[k : k + ROWS][order], ib[k : k + ROWS][order]
            total = np.zeros(len(a))
            for v in self.cells:
                d = v[a]
                d -= v[b]
                d *= d
                total += d
            out[k + order] = np.sqrt(total)
        return out

    def keys(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        return self.id[np.minimum(ia, ib)] * KEY + self.id[np.maximum(ia, ib)]

    def pairs(self, piece: int, n: int, gaps: bytes):
        """Places in the piece or draws, rows a and b, and distances, batch by batch."""
        if piece < 0:
            d = np.cumsum(draws.unpack(gaps, n))
            d = d[d <= self.last]
            for k in range(0, len(d), ROWS):
                a, b = self.drawn(d[k : k + ROWS])
                yield d[k : k + ROWS], a, b, self.between(a, b)
            return
        first = 0
        for i, ie, j, je in self.blocks[piece * PIECE : (piece + 1) * PIECE]:
            a, b = self.order[i:ie], self.order[j:je]
            total = np.zeros((len(a), len(b)))
            d = np.empty_like(total)
            for v in self.cells:
                np.subtract(v[a][:, None], v[b][None, :], out=d)
                d *= d
                total += d
            yield first + np.arange(total.size), np.repeat(a, len(b)), np.tile(b, len(a)), np.sqrt(total).ravel()
            first += total.size


class Balanced:
    """The pairs of pairs.balanced, scored; in `folds` folds by their keys, if told."""

    def __init__(self, samples: DataFrame, rows: Rows, work: DataFrame, folds: int | None):
        self.spark, self.work, self.folds = samples.sparkSession, work, folds
        self.held = self.spark.sparkContext.broadcast(rows)

    @staticmethod
    def of(samples: DataFrame, folds: int | None = None) -> Balanced | None:
        """None where the vectors don't go along or aren't finite, ids are repeated, or classes are small."""
        from .pairs import negatives_there

        rows = samples.where("id is not null").select("id", "person", "cam", "x")
        told = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).first()
        if told["n"] > told["k"] or held.small_classes(rows):
            return None
        t = held.gathered(rows.select("id", "x"), "id")
        if t is None or not np.isfinite(held.cells(t)).all():
            return None
        spark = samples.sparkSession
        r = Rows(samples, t)
        n = -(-len(r.blocks) // PIECE)
        work = spark.range(0, n, 1, min(n, 8 * spark.sparkContext.defaultParallelism)).select(F.col("id").alias("piece"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("gaps"))
        told = draws.chosen(samples, r, spark.sparkContext.broadcast(r), negatives_there(samples))
        if told is not None:
            first, r.last = told
            work = work.unionByName(first.select(F.lit(-1).cast("long").alias("piece"), "n", F.col("draws").alias("gaps")))
        return Balanced(samples, r, work, folds)

    def sums(self) -> DataFrame:
        """fold, __part, sp, sq: matches and others in each bin of distances."""
        held_, folds = self.held, self.folds or 1

        def run(batches):
            r, c = held_.value, np.zeros(2 * folds * BINS, np.int64)
            for batch in batches:
                for w in batch.to_pylist():
                    for _, a, b, distance in r.pairs(w["piece"], w["n"], w["gaps"]):
                        at = bins(distance)
                        if folds > 1:
                            at += r.keys(a, b) % folds * BINS
                        at += (w["piece"] < 0) * folds * BINS
                        low = int(at.min())
                        some = np.bincount(at - low)
                        c[low : low + len(some)] += some
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"match": at < folds * BINS, "fold": (at // BINS % folds).astype(np.int32), "__part": at % BINS, "n": c[at]})

        x = self.work.mapInArrow(run, "match boolean, fold int, __part long, n long")
        n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        return x.groupBy("fold", "__part").agg(n(F.col("match")).alias("sp"), n(~F.col("match")).alias("sq"))

    def rows(self, some: DataFrame | None = None) -> DataFrame:
        """fold, key, match, distance, __part of all pairs, or those of some(fold, __part)."""
        held_, folds = self.held, self.folds or 1
        only = None
        if some is not None:
            t = some.select("fold", "__part").toArrow()
            only = np.sort(t.column("fold").to_numpy().astype(np.int64) * BINS + t.column("__part").to_numpy())

        def run(batches):
            r = held_.value
            for batch in batches:
                for w in batch.to_pylist():
                    for _, a, b, distance in r.pairs(w["piece"], w["n"], w["gaps"]):
                        part = bins(distance)
                        if only is not None and folds == 1:
                            near = np.flatnonzero(np.isin(part, only))
                            a, b, distance, part = a[near], b[near], distance[near], part[near]
                        key = r.keys(a, b)
                        fold = key % folds
                        if only is not None and folds > 1:
                            near = np.flatnonzero(np.isin(fold * BINS + part, only))
                            key, fold, distance, part = key[near], fold[near], distance[near], part[near]
                        yield pa.RecordBatch.from_pydict({"fold": fold.astype(np.int32), "key": key, "match": np.full(len(key), w["piece"] >= 0), "distance": distance, "__part": part})

        return self.work.mapInArrow(run, "fold int, key long, match boolean, distance double, __part long")

    def roc(self) -> DataFrame | None:
        """k, tpr, fpr of all pairs by rising distance, then key, without (0, 0); None if a bin has more pairs than a task should sort."""
        t = self.sums().groupBy("__part").agg(F.sum("sp").alias("sp"), F.sum("sq").alias("sq")).orderBy("__part").toArrow()
        part, sp, sq = (t.column(c).to_numpy() for c in ("__part", "sp", "sq"))
        n = sp + sq
        if n.max(initial=0) > 4 * RANGE:
            return None
        of = (np.cumsum(n) - n) // RANGE
        names, starts = np.unique(of, return_index=True)
        ranges = np.zeros(BINS, np.int64)
        ranges[part] = np.searchsorted(names, of)
        before_p, before_q = (np.cumsum(c) - c for c in (sp, sq))
        before_p, before_q, n_p, n_q = before_p[starts], before_q[starts], int(sp.sum()), int(sq.sum())
        held_ = self.held

        def deal(batches):
            r = held_.value
            for batch in batches:
                for w in batch.to_pylist():
                    found = [(at, ranges[bins(distance)]) for at, _, _, distance in r.pairs(w["piece"], w["n"], w["gaps"])]
                    if not found:
                        continue
                    at, to = (np.concatenate(c) for c in zip(*found))
                    order = np.argsort(to.astype(np.uint16 if len(names) < 1 << 16 else np.int64), kind="stable")
                    at, to = at[order], to[order]
                    ends = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                    rows = list(zip(ends[:-1], ends[1:]))
                    yield pa.RecordBatch.from_pydict({"range": to[ends[:-1]], "piece": [w["piece"]] * len(rows), "n": np.diff(ends), "gaps": pa.array([draws.pack(np.diff(at[s:e], prepend=0)) for s, e in rows], pa.binary())})

        def sort(t: pa.Table) -> pa.Table:
            r, k = held_.value, t.column("range")[0].as_py()
            distance, key, match = [], [], []
            for w in t.to_pylist():
                at = np.cumsum(draws.unpack(w["gaps"], w["n"]))
                a, b = r.drawn(at) if w["piece"] < 0 else r.placed(w["piece"], at)
                distance.append(r.between(a, b))
                key.append(r.keys(a, b))
                match.append(np.full(len(at), w["piece"] >= 0))
            match = np.concatenate(match)[np.lexsort((np.concatenate(key), np.concatenate(distance)))]
            tp = before_p[k] + np.cumsum(match)
            fp = before_q[k] + np.cumsum(~match)
            return pa.table({"k": tp + fp, "tpr": tp / max(n_p, 1), "fpr": fp / max(n_q, 1)})

        dealt = self.work.mapInArrow(deal, "range long, piece long, n long, gaps binary")
        return dealt.groupBy("range").applyInArrow(sort, "k long, tpr double, fpr double")
