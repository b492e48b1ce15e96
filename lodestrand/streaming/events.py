"""Streaming forms: idempotent events with keyed state, ledgers by micro-batch, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import synced


def idempotent_stream(events: DataFrame, key: list[str], order: list[str], payload: str = "payload_hash") -> DataFrame:
    """The streaming form of incremental.idempotent: per key the first payload and whether another one came.

    Batches are read in order; within one, rows of a key are sorted by `order`.
    """
    schema = events.withColumn("status", F.lit("")).schema

    def judge(_, frames, state):
        first, clashed = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for value in rows[payload]:
            if first is None:
                first = value
                out.append("processable")
                continue
            clashed = clashed or value != first
            out.append("conflict" if clashed else "duplicate")
        state.update((first, bool(clashed)))
        yield rows.assign(status=out)

    return events.groupBy(*key).applyInPandasWithState(judge, schema, "first string, clashed boolean", "append", "NoTimeout")


def sync_each_batch(load: Callable[[], DataFrame], save: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies item changes to a ledger in delta mode."""

    def apply(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("item_id").agg(F.max_by(F.struct("operation", "content_hash"), "ts").alias("c")).select("item_id", "c.*")
        save(synced(load(), latest, full=False))

    return apply


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
