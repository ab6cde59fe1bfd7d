"""Cross validation over labelled pairs that are made anew in the tasks by each pass: positives in blocks of classes, other pairs by their places. No pair is stored.

A pair's fold is that of id_a, its key is id_a * KEY + id_b; id_a is the smaller id of a positive, and the drawing row of another pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import balance, held

KEY = 100_000
#: Bytes of vectors that a task may hold, under the metrics of all folds.
HELD_BYTES = 1 << 28
#: Blocks of positives or thousands of other pairs in a piece of work.
PIECE, OTHERS = balance.PIECE, 1 << 15


class Rows:
    """What the tasks hold: vectors in the order of ids, blocks of positives, and the places of other pairs."""

    def __init__(self, t: pa.Table, others: pa.Table, folds: int):
        self.folds, self.id, self.x = folds, t.column("id").to_numpy(), np.ascontiguousarray(held.cells(t))
        person, cam = (np.unique(np.array(t.column(c).fill_null(0).to_pylist()), return_inverse=True)[1] for c in ("person", "cam"))
        whole = np.asarray(t.column("person").is_valid()) & np.asarray(t.column("cam").is_valid())
        self.order, self.blocks = held.class_blocks(whole, person, cam)
        self.a, self.b = (np.searchsorted(self.id, others.column(c).to_numpy()) for c in ("id_a", "id_b"))
        self.turns = self.cells = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"turns": None, "cells": None}

    def sides(self, piece: int):
        """Fold, rows a and b, and whether all of these meet: blocks where one side has all the smaller ids, or else pair by pair."""
        if piece < 0:
            first = (-1 - piece) * OTHERS
            a, b = self.a[first : first + OTHERS], self.b[first : first + OTHERS]
            fold = self.id[a] % self.folds
            for f in np.unique(fold):
                yield int(f), a[fold == f], b[fold == f], False
            return
        for i, ie, j, je in self.blocks[piece * PIECE : (piece + 1) * PIECE]:
            a, b = self.order[i:ie], self.order[j:je]
            if a[0] > b[-1]:  # places rise with ids
                a, b = b, a
            if a[-1] < b[0]:
                fold = self.id[a] % self.folds
                for f in np.unique(fold):
                    yield int(f), a[fold == f], b, True
                continue
            low, high = np.minimum(a[:, None], b[None, :]).ravel(), np.maximum(a[:, None], b[None, :]).ravel()
            fold = self.id[low] % self.folds
            for f in np.unique(fold):
                yield int(f), low[fold == f], high[fold == f], False

    def scatter(self, piece: int, centre: np.ndarray):
        """Fold, number of pairs and the sum of (a-b)(a-b)' over them."""
        for f, a, b, meet in self.sides(piece):
            x, y = self.x[a] - centre, self.x[b] - centre
            if meet:
                cross = np.outer(x.sum(axis=0), y.sum(axis=0))
                yield f, len(a) * len(b), len(b) * (x.T @ x) + len(a) * (y.T @ y) - cross - cross.T
            else:
                x -= y
                yield f, len(a), x.T @ x

    def under(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Keeps the vectors by cell under the metric of each fold; sums go cell by cell, so equal vectors stay equal."""
        if self.turns is None or not all(np.array_equal(a[0], b[0]) for a, b in zip(self.turns, turns)):
            self.cells, x = [], np.ascontiguousarray(self.x.T)
            for l, _ in turns:
                out = np.empty((len(l), x.shape[1]))
                for row, to in zip(l, out):
                    np.multiply(x[0], row[0], out=to)
                    for c in range(1, len(x)):
                        to += row[c] * x[c]
                self.cells.append(out)
            self.turns = turns

    def pairs(self, piece: int):
        """Fold, rows a and b, and distances, batch by batch."""
        for f, a, b, meet in self.sides(piece):
            if meet:
                shape, at = (len(a), len(b)), lambda v, a=a, b=b: (v[a][:, None], v[b][None, :])
            else:
                shape, at = (len(a),), lambda v, a=a, b=b: (v[a], v[b])
            total, d = np.zeros(shape), np.empty(shape)
            for v, sign in zip(self.cells[f], self.turns[f][1]):
                np.subtract(*at(v), out=d)
                d *= d
                if sign < 0:
                    total -= d
                else:
                    total += d
            distance = np.sqrt(np.maximum(total, 0.0, out=total)).ravel()
            yield f, *((np.repeat(a, len(b)), np.tile(b, len(a))) if meet else (a, b)), distance


class Folded:
    """fold, key, match, distance of all labelled pairs, each under the metric that learner(positive, negative) gives of the other folds' covariances."""

    def __init__(self, spark, rows: Rows, learner: Callable):
        n, m, folds = -(-len(rows.blocks) // PIECE), -(-len(rows.a) // OTHERS), rows.folds
        pieces = spark.range(-m, n).repartition(max(1, min(n + m, 8 * spark.sparkContext.defaultParallelism)), "id")
        self.work, self.folds = pieces.select(F.col("id").alias("piece")), folds
        self.held = held_ = spark.sparkContext.broadcast(rows)
        centre, d = rows.x.mean(axis=0), rows.x.shape[1]

        def run(batches):
            r, sums, n = held_.value, np.zeros((2, folds, d, d)), np.zeros((2, folds))
            for batch in batches:
                for piece in batch.column("piece").to_pylist():
                    for f, k, s in r.scatter(piece, centre):
                        n[int(piece >= 0), f] += k
                        sums[int(piece >= 0), f] += s
            yield pa.RecordBatch.from_pydict({"v": [[*n.ravel().tolist(), *sums.ravel().tolist()]]})

        parts = self.work.mapInArrow(run, "v array<double>").toArrow()  # d by d cells a fold and task
        told = sum(v.values.to_numpy() for v in parts.column("v"))
        n, sums = told[: 2 * folds].reshape(2, folds), told[2 * folds :].reshape(2, folds, d, d)
        self.turns = []
        for f in range(folds):
            neg, pos = ((s.sum(axis=0) - s[f]) / (k.sum() - k[f]) if k.sum() > k[f] else np.zeros((0, 0)) for s, k in zip(sums, n))
            values, vectors = np.linalg.eigh(((m := learner(pos, neg)) + m.T) / 2)
            self.turns.append((np.sqrt(np.abs(values))[:, None] * vectors.T, np.sign(values)))

    @staticmethod
    def of(samples: DataFrame, learner: Callable, folds: int) -> Folded | None:
        """None where the vectors don't go along or aren't finite, ids are repeated, missing or negative, or classes are small."""
        from .pairs import negatives

        rows = samples.select("id", "person", "cam", "x")
        told = rows.agg(F.count("*").alias("rows"), F.count("id").alias("n"), F.count_distinct("id").alias("k"), F.min("id").alias("least")).first()
        if told["rows"] > told["k"] or not told["n"] or told["least"] < 0 or held.small_classes(rows):
            return None
        t = held.gathered(rows, "id")
        if t is None or folds * t.num_rows * len(t.column("x")[0]) * 8 > HELD_BYTES or not np.isfinite(held.cells(t)).all():
            return None
        others = negatives(rows.select("id", "person", "cam")).select("id_a", "id_b").toArrow()  # a few draws a row
        return Folded(samples.sparkSession, Rows(t, others, folds), learner)

    def sums(self) -> DataFrame:
        """fold, __part, sp, sq: matches and others in each bin of distances."""
        held_, turns, folds = self.held, self.turns, self.folds

        def run(batches):
            r, c = held_.value, np.zeros((2, folds, balance.BINS), np.int64)
            r.under(turns)
            for batch in batches:
                for piece in batch.column("piece").to_pylist():
                    for f, _, _, distance in r.pairs(piece):
                        at = balance.bins(distance)
                        low = int(at.min())
                        some = np.bincount(at - low)
                        c[int(piece >= 0), f, low : low + len(some)] += some
            match, fold, at = np.nonzero(c)
            yield pa.RecordBatch.from_pydict({"match": match == 1, "fold": fold.astype(np.int32), "__part": at, "n": c[match, fold, at]})

        x = self.work.mapInArrow(run, "match boolean, fold int, __part long, n long")
        n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        return x.groupBy("fold", "__part").agg(n(F.col("match")).alias("sp"), n(~F.col("match")).alias("sq"))

    def rows(self, some: DataFrame) -> DataFrame:
        """fold, key, match, distance, __part of the pairs of some(fold, __part)."""
        held_, turns, folds = self.held, self.turns, self.folds
        t = some.select("fold", "__part").toArrow()
        only = np.zeros((folds, balance.BINS), bool)
        only[t.column("fold").to_numpy(), t.column("__part").to_numpy()] = True
        only = np.packbits(only)

        def run(batches):
            r, wanted = held_.value, np.unpackbits(only).reshape(folds, -1).astype(bool)
            r.under(turns)
            for batch in batches:
                for piece in batch.column("piece").to_pylist():
                    for f, a, b, distance in r.pairs(piece):
                        part = balance.bins(distance)
                        near = np.flatnonzero(wanted[f][part])
                        key = r.id[a[near]] * KEY + r.id[b[near]]
                        yield pa.RecordBatch.from_pydict({"fold": np.full(len(near), f, np.int32), "key": key, "match": np.full(len(near), piece >= 0), "distance": distance[near], "__part": part[near]})

        return self.work.mapInArrow(run, "fold int, key long, match boolean, distance double, __part long")
