"""Streams with bounded state: entries that expire by event-time timers, and rings that keep the newest entries of a key.

Both need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass) and sessions in UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .limits import _millis


class _Expiring(StatefulProcessor):
    """Map state: entry -> (end in milliseconds, order of its last event)."""

    def __init__(self, key: str, id_: str, ends: str, removes: str, order: str) -> None:
        self.key, self.id, self.ends, self.removes, self.order = key, id_, ends, removes, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getMapState("entries", "id string", "ends long, at long")

    def _told(self, key, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *t) for t in told], columns=[self.key, self.id, "change", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, told = pd.concat(list(rows)).sort_values(self.order), []
        passed = timerValues.getCurrentWatermarkInMs()
        for id_, ends, removes, at in zip(batch[self.id], batch[self.ends], batch[self.removes], batch[self.order], strict=True):
            known = self.entries.containsKey((id_,))
            if removes:
                if known:
                    self.entries.removeKey((id_,))
                    told.append((id_, "removed", at))
                continue
            end = _millis(ends)
            if end <= passed:
                told.append((id_, "late", at))
                continue
            self.entries.updateValue((id_,), (end, at))
            self.handle.registerTimer(end)
            told.append((id_, "replaced" if known else "added", at))
        yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(id_[0], value[1]) for id_, value in self.entries.iterator() if value[0] <= now]
        for id_, _ in over:
            self.entries.removeKey((id_,))
        yield self._told(key, [(id_, "expired", at) for id_, at in over])

    def close(self) -> None:
        pass


def expiring(requests: DataFrame, key: str, id_: str, ends: str, removes: str, order: str) -> DataFrame:
    """key, id, change, at: what becomes of each key's entries. added, replaced (by one with the same id), removed, expired, or late: it
    had ended already when it came.

    requests: a stream with a watermark; id (a text) names an entry, which lives until `ends`, unless `removes` takes it away before.
    Requests of a micro-batch are taken in `order` (a whole number). An entry goes when the watermark passes its end; a key
    without entries holds no state.
    """
    rows = requests.select(key, id_, ends, removes, order, *[c for c in requests.columns if c not in {key, id_, ends, removes, order}])
    kinds = dict(requests.dtypes)
    schema = f"{key} {kinds[key]}, {id_} string, change string, at long"
    return rows.groupBy(key).transformWithStateInPandas(_Expiring(key, id_, ends, removes, order), schema, outputMode="Append", timeMode="EventTime")


class _Ring(StatefulProcessor):
    """Map state: entry -> (place in the ring, value); value state: the last place given and how many entries there are."""

    def __init__(self, key: str, id_: str, value: str, order: str, most: int, moves: bool) -> None:
        self.key, self.id, self.value, self.order, self.most, self.moves = key, id_, value, order, most, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "id string", "place long, value string")
        self.ends = handle.getValueState("ends", "last long, step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, step = self.ends.get() if self.ends.exists() else (0, 0)
        held = {id_[0]: tuple(v) for id_, v in self.entries.iterator()}  # `most` entries at the most
        before = dict(held)
        batch = pd.concat(list(rows)).sort_values(self.order)
        for id_, value in zip(batch[self.id], batch[self.value], strict=True):
            known = held.get(id_)
            if known is None or self.moves:
                last += 1
            place = last if known is None or self.moves else known[0]
            held[id_] = (place, value if isinstance(value, str) else known[1] if known else None)
            if len(held) > self.most:
                del held[min(held, key=lambda k: held[k][0])]
        for id_ in before.keys() - held.keys():
            self.entries.removeKey((id_,))
        for id_, v in held.items():
            if before.get(id_) != v:
                self.entries.updateValue((id_,), v)
        self.ends.update((last, step + 1))
        order = sorted(held, key=lambda k: held[k][0])
        yield pd.DataFrame([(key[0], step + 1, n + 1, id_, held[id_][1]) for n, id_ in enumerate(order)], columns=[self.key, "step", "place", self.id, self.value])

    def close(self) -> None:
        pass


def ring(events: DataFrame, key: str, id_: str, value: str, order: str, most: int, moves: bool) -> DataFrame:
    """key, step, place, id, value: a key's list after each micro-batch that has events of it, oldest first; the largest step is the present.

    A list has `most` ids at the most: a new one comes last and the first goes when there are too many, as in `operators.folds.ring`. value: the
    last one of the id that wasn't null since it came in. State holds `most` entries a key.
    """
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, step long, place long, {id_} string, {value} string"
    return events.select(key, id_, value, order).groupBy(key).transformWithStateInPandas(_Ring(key, id_, value, order, most, moves), schema, outputMode="Append", timeMode="None")
