"""Streaming forms; each gives the rows of its batch form once the stream has been read."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Ends, Rule


def distinct_events(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key within the watermark: replay and view de-duplication."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def calendar_counts(events: DataFrame, key: str, ts: str, late: str, unit: str = "1 day", offset: str = "15 hours") -> DataFrame:
    """Events per key and tumbling window (days at UTC+9 start at 15:00 UTC); closed by the watermark."""
    windows = F.window(ts, unit, unit, offset)
    return events.withWatermark(ts, late).groupBy(key, windows.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("bucket"), "n")


def running_points(ledger: DataFrame) -> DataFrame:
    """actor, points so far (update or complete mode): the incremental form of a summed ledger."""
    return ledger.groupBy("actor").agg(F.sum("delta").alias("points"))


def flushed(rows: DataFrame, sink, checkpoint: str, every: str = "80 milliseconds"):
    """A running query that gives sink(batch, number) what has come since the last flush, at most once in `every`."""
    return rows.writeStream.foreachBatch(sink).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def tool_calls(events: DataFrame, key: str, output: str, order: str) -> DataFrame:
    """key, its last output that isn't null and its last event so far (update or complete mode)."""
    known = F.when(F.col(output).isNotNull(), F.col(order))
    return events.groupBy(key).agg(F.max_by(output, known).alias(output), F.max(order).alias("last"))


def _millis(at: datetime) -> int:
    """Milliseconds of a time in UTC, rounded up."""
    return -((datetime(1970, 1, 1) - at) // timedelta(milliseconds=1))


class _Fold(StatefulProcessor):
    """Keeps a rule's state of each key, pickled. With `ends`, a timer clears it once the watermark passes its end."""

    def __init__(self, order: list[str], values: list[str], names: list[str], rule: Rule, ends: Ends | None = None) -> None:
        self.order, self.values, self.names, self.step, self.ends = order, values, names, rule[1], ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "state binary")

    def _load(self):
        return pickle.loads(self.state.get()[0]) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        batch = pd.concat(list(rows)).sort_values(self.order)
        made = []
        for values in zip(*(batch[c] for c in self.values), strict=True):
            state, out = self.step(state, *values)
            made.append(out)
        self.state.update((pickle.dumps(state),))
        end = self.ends(state) if self.ends else None
        if end is not None:
            self.handle.registerTimer(_millis(end))
        yield batch.assign(**dict(zip(self.names, zip(*made, strict=True), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = self.ends(self._load()) if self.state.exists() else None
        if end is not None and _millis(end) <= expiredTimerInfo.getExpiryTimeInMs():  # a later event may have moved the end
            self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def fold(events: DataFrame, key: str, order: list[str], values: list[str], rule: Rule, ends: Ends | None = None) -> DataFrame:
    """`operators.folds.fold` on a stream: all events with the rule's columns, in order within each micro-batch.

    A micro-batch's rows of one key are sorted in memory; events that come in a later micro-batch count as later. ends: tells when a state is as
    good as none; `events` must have a watermark then, and a key is forgotten when it passes that time.
    Spark needs its RocksDB state store for this (spark.sql.streaming.stateStore.providerClass).
    """
    added = [c.split() for c in rule[0].split(", ")]
    schema = events.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in added)).schema
    processor = _Fold(order, values, [name for name, _ in added], rule, ends)
    return events.groupBy(key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime" if ends else "None")
