"""Rules whose decisions depend on earlier decisions of the same key: windows from the first event, locks and reservations.

`fold` deals rows out by key and sorts them; a task then holds the state of one key at a time and streams through its rows, so
a key of any size needs no memory. A key's decisions are made in order, hence by one task: that is the rule's own meaning.
Rows with a null key form one key.

A rule is a pair (added columns as a schema, step); step(state, *values) gives (state, values of the added columns), and the state
is None at first. The streaming forms in `streaming.limits` use the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[..., tuple]
Rule = tuple[str, Step]
#: From a rule's state to when it is as good as none; None: never.
Ends = Callable[[object], datetime | None]
_ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}


def fold(rows: DataFrame, key: str, order: list[str], values: list[str], rule: Rule) -> DataFrame:
    """All rows and columns of `rows`, and the columns that the rule adds."""
    added, step = rule
    names, kinds = zip(*(c.split() for c in added.split(", ")), strict=True)
    schema = rows.select("*", *(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True))).schema
    own = rows.repartition(key).sortWithinPartitions(key, *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            made = []
            for k, *v in zip(*(batch.column(c).to_pylist() for c in (key, *values)), strict=True):
                if not begun or k != at:
                    at, state, begun = k, None, True
                state, out = step(state, *v)
                made.append(out)
            new = [pa.array(c, _ARROW[k]) for c, k in zip(zip(*made, strict=True) if made else [[]] * len(names), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return own.mapInArrow(work, schema)


def _seconds(until: datetime, now: datetime) -> int:
    return max(1, ceil((until - now).total_seconds()))


def window_limit(limit: int, seconds: int) -> Rule:
    """values: ts. `limit` events in a window that starts with its first event; refused events don't extend it."""
    width = timedelta(seconds=seconds)

    def step(state, ts):
        if state is None or state[0] <= ts:
            return (ts + width, 1), (True, max(0, limit - 1), 0)
        until, count = state
        if count >= limit:
            return state, (False, 0, _seconds(until, ts))
        return (until, count + 1), (True, max(0, limit - count - 1), 0)

    return "admitted boolean, remaining long, retry_after long", step


def window_ends(state) -> datetime | None:
    """A window is over at its end."""
    return state[0]


def cooldown_ends(seconds: int) -> Ends:
    """What happened `seconds` ago is forgotten."""
    return lambda last: last + timedelta(seconds=seconds)


def reservation_ends(state) -> datetime | None:
    """A reservation that nothing was bound by ends with its time; bound accounts stay counted."""
    return state[1] if state and not state[0] else None


def cooldown(seconds: int) -> Rule:
    """values: ts. Admitted if `seconds` have passed since the last admitted event."""
    width = timedelta(seconds=seconds)

    def step(last, ts):
        if last is None or ts - last >= width:
            return ts, (True, 0)
        return last, (False, _seconds(last + width, ts))

    return "admitted boolean, retry_after long", step


def failure_lock(most: int = 10, seconds: int = 900) -> Rule:
    """values: ts, failed. Attempts during a lock are refused and change nothing; a success clears the count, a lock's end doesn't."""
    width = timedelta(seconds=seconds)

    def step(state, ts, failed):
        fails, until = state or (0, None)
        if until is not None and until > ts:
            return state, ("locked", fails, _seconds(until, ts))
        if not failed:
            return (0, None), ("ok", 0, 0)
        fails += 1
        if fails >= most:
            return (fails, ts + width), ("locking", fails, seconds)
        return (fails, until), ("failed", fails, 0)

    return "outcome string, fails long, retry_after long", step


def reservation(most_accounts: int = 1, seconds: int = 600) -> Rule:
    """values: ts, binds. A reservation is refused at the limit of accounts or while another holds; a binding counts and frees."""
    width = timedelta(seconds=seconds)

    def step(state, ts, binds):
        count, until = state or (0, None)
        if binds:
            return (count + 1, ts), ("bound", count + 1)
        if count >= most_accounts:
            return state, ("limit", count)
        if until is not None and until > ts:
            return state, ("held", count)
        return (count, ts + width), ("reserved", count)

    return "outcome string, accounts long", step


def cached(seconds: int) -> Rule:
    """values: ts. hit: whether what was computed last is younger than `seconds`; else it is computed anew, at ts."""
    width = timedelta(seconds=seconds)

    def step(at, ts):
        if at is not None and ts < at + width:
            return at, (True,)
        return ts, (False,)

    return "hit boolean", step


def ring(most: int, moves: bool) -> Rule:
    """values: id. A list of at most `most` ids: a new one comes last, and the first goes when there are too many. moves: an id that
    comes again goes to the end, too. evicted: the id that had to go; kept: ids that are in the list after it."""

    def step(ids, new):
        ids = list(ids or [])
        if new in ids and not moves:
            return ids, (None, len(ids))
        ids = [x for x in ids if x != new] + [new]
        gone = ids.pop(0) if len(ids) > most else None
        return ids, (gone, len(ids))

    return "evicted string, kept long", step


def challenge(most_attempts: int = 5) -> Rule:
    """values: ts, expires, given, answer. An expired or solved challenge is gone; wrong answers count towards a lock."""

    def step(state, ts, expires, given, answer):
        attempts, gone = state or (0, False)
        if gone:
            return state, ("not_found",)
        if expires <= ts:
            return (attempts, True), ("expired",)
        if attempts >= most_attempts:
            return (attempts, False), ("locked",)
        if not given:
            return (attempts, False), ("required",)
        if given != answer:
            return (attempts + 1, False), ("invalid",)
        return (attempts, True), ("ok",)

    return "outcome string", step


def growing_text() -> Rule:
    """values: text. The text so far of a message that is sent again and again: one that is shorter is not taken."""

    def step(state, text):
        state = text if text is not None and (state is None or len(text) >= len(state)) else state
        return state, (state,)

    return "shown string", step


def sequence_gaps() -> Rule:
    """values: seq. expected: the number that should have come, where one or more are missing before seq."""

    def step(last, seq):
        gap = last + 1 if last is not None and seq > last + 1 else None
        return seq, (gap,)

    return "expected long", step
