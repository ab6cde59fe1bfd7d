"""Descriptors that arrive as a stream, ranked against a fixed gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate, score


def rank_stream(probes: DataFrame, gallery: DataFrame, sink, top: int = 10):
    """Starts a query that scores each micro-batch of probes(id, person, cam, x) and gives sink(ranked, epoch) the top rows of each probe."""

    def each(batch: DataFrame, epoch: int) -> None:
        ranked = evaluate.ranked(score.score(batch, gallery))
        sink(ranked.where(f"rk <= {int(top)}"), epoch)

    return probes.writeStream.foreachBatch(each).trigger(availableNow=True)
