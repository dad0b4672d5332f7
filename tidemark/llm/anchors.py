"""Repeated windows of a corpus, brought together through anchors.

A unit is a byte or a word; a window is `window` consecutive units of one document. Of the grams of `gram` units in a window,
the one with the smallest hash is its anchor (the leftmost of equal ones), so equal windows have equal anchors at equal
places. An anchor's context is all that its windows can reach: `window - gram` units before it and `window` from its start.

1. `meet` finds the anchors of each document, about 2 in window - gram + 2 units, and tells those whose gram occurs at several
   places: its points. A task sends on each gram once, however often it has it.
2. `read_contexts` reads the contexts of such points. Callers compare them in groups of a key: the gram, or, for grams with very
   many contexts (`hot_grams`), the gram with most of a window around it, so that one common line doesn't make one group.
3. `cover` joins ranges found to their documents.

A document is known by doc_id and a hash of its text: rows that share both are one document, and get the same result. A null
doc_id is smaller than all others.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
NULL_ID = -(1 << 63)
#: Anchors held by a task before they are packed and passed on.
HELD = 1_500_000
#: Units that are searched for anchors at once.
SEARCHED = 1 << 20
#: A gram is hot from this many contexts on, and from a ten-thousandth of those of all such grams: 10,000 grams at most.
HOT, HOT_SHARE = 10_000, 10_000
#: Keys of a hot gram: each has the windows of a tenth of the offsets, and all but a tenth of a window is in the key.
HOT_KEYS = 10


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BLOCK = 1 << 16
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_UP_STEP, _DOWN_STEP = pow(_BASE, _BLOCK, 1 << 64), pow(_INVERSE, _BLOCK, 1 << 64)


class Rolling:
    """Prefix polynomial hashes modulo 2^64 of an array of 64-bit units, or of numbers into a table `values` of them."""

    def __init__(self, units: np.ndarray, values: np.ndarray | None = None):
        n = len(units)
        up = _powers(_UP_STEP, n // _BLOCK + 1)
        self.down = _powers(_DOWN_STEP, n // _BLOCK + 1)
        self.sums = np.zeros(n + 1, _U)
        for k in range(0, n, _BLOCK):
            part = units[k : k + _BLOCK] if values is None else values[units[k : k + _BLOCK]]
            own = self.sums[k + 1 : k + 1 + len(part)]
            np.cumsum(part * _UP[: len(part)], out=own)
            own *= up[k // _BLOCK]
            own += self.sums[k]

    def scale(self, low: np.ndarray) -> np.ndarray:
        """What makes sums[high] - sums[low] the hash of [low, high)."""
        return _DOWN[low & (_BLOCK - 1)] * self.down[low >> 16]

    def span(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of the unit ranges [low, high); equal ranges have equal hashes wherever they lie."""
        return (self.sums[high] - self.sums[low]) * self.scale(low)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.scale(np.arange(n)) if n > 0 else np.zeros(0, _U)


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int

    @property
    def before(self) -> int:
        return self.window - self.gram

    def key_ranges(self) -> list[tuple[int, int]]:
        """(units before the anchor, units from it on) that all windows of each tenth of the offsets have."""
        edges = np.linspace(0, self.before + 1, min(HOT_KEYS, self.before + 1) + 1).astype(int).tolist()
        return [(a, self.window - (b - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def _find(units: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    rolling = Rolling(units)
    grams = common.mix(rolling.grams(shape.gram))
    bits = SEARCHED.bit_length()
    keys = (grams >> _U(bits) << _U(bits)) | np.arange(len(grams), dtype=_U)
    least = sliding_min(keys, shape.before + 1)
    lengths = np.diff(starts)
    real = np.repeat(starts[1:], lengths)[: len(least)] - np.arange(len(least)) >= shape.window
    chosen = np.zeros(len(grams), bool)
    chosen[(least[real] & _U((1 << bits) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(starts, at, "right") - 1
    low, high = np.maximum(starts[doc], at - shape.before), np.minimum(starts[doc + 1], at + shape.window)
    return doc, at - starts[doc], grams[at], rolling.span(low, high)


def find(units: np.ndarray, starts: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, place in it, gram hash, hash of the context) of the anchors of concatenated documents, a part at a time.

    Places near the cut of two parts may come twice, and contexts there are cut.
    """
    for low in range(0, len(units), SEARCHED):
        own = units[low : low + SEARCHED + shape.window - 1]
        if len(own) < shape.window:
            return
        bounds = np.clip(starts, low, low + len(own))
        doc, at, gram, context = _find(own, bounds - low, shape)
        yield doc, at + bounds[doc] - starts[doc], gram, context


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ranges as the fewest pairs."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    return np.stack([low[new], high[np.append(new[1:], True)]], 1)


def ranges_by_document(doc_id, tie, low, high) -> Iterator[tuple[int, int, bytes]]:
    """Merged ranges of each document as int32 pairs."""
    order = np.lexsort((low, tie, doc_id))
    doc_id, tie, low, high = doc_id[order], tie[order], low[order], high[order]
    edges = [*np.flatnonzero(~same_as_before(doc_id, tie)).tolist(), len(low)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(doc_id[a]), int(tie[a]), merged(low[a:b], high[a:b]).astype("<i4").tobytes()


def identity(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, tie (a hash of the text), text; nulls are the smallest id and the empty text. Other columns as `rest`."""
    text = F.coalesce("text", F.lit(""))
    rest = [F.struct(*also).alias("rest")] if also else []
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"), *rest)


Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

FOUND = "doc_id long, tie long, kind int, data binary"
COVERED, POINTS, MANY = 0, 1, 2
POINT = np.dtype([("gram", "<u8"), ("at", "<u4")])


def found_rows(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 20_000):
        columns = zip(*rows[low : low + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "tie", "kind", "data"])


def packed_rows(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[low : low + 64]], pa.int32()), pa.array([r[1] for r in rows[low : low + 64]], pa.binary())], names=["bucket", "packed"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The packed values of one bucket after another, from rows (bucket, packed) sorted by bucket."""
    held, own = [], None
    for batch in batches:
        for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
            if b != own and held:
                yield held
                held = []
            own = b
            held.append(packed.as_buffer())
    if held:
        yield held


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(common.tasks(rows), "bucket").sortWithinPartitions("bucket")


def parts(numbers: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, rows that have it) of each number below n that occurs."""
    order = np.argsort(numbers, kind="stable")
    edges = np.searchsorted(numbers[order], np.arange(n + 1))
    for k in range(n):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def _points(doc_id, tie, gram, at) -> list[tuple[int, int, int, bytes]]:
    """Rows of POINTS by document."""
    order = np.lexsort((at, tie, doc_id))
    doc_id, tie, points = doc_id[order], tie[order], np.rec.fromarrays([gram[order], at[order]], dtype=POINT)
    edges = [*np.flatnonzero(~same_as_before(doc_id, tie)).tolist(), len(points)]
    return [(int(doc_id[a]), int(tie[a]), POINTS, points[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def meet(docs: DataFrame, units_of: Callable[[], Units], shape: Shape, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, tie, kind, data) of identity(docs). A written table.

    POINTS: the document's anchors whose gram occurs at several places. MANY: a gram (as doc_id) with `hot` contexts or more,
    and how many (as tie; contexts that several tasks have count once for each).
    """
    buckets = 4 * common.tasks(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held, ids, ties = units_of(), [], [], []
        docs_held = anchors_held = 0

        def pack() -> Iterator[pa.RecordBatch]:
            doc, at, gram, context = (np.concatenate(c) for c in zip(*held, strict=True))
            table, number = np.unique(np.stack([np.concatenate(ids), np.concatenate(ties)], 1), axis=0, return_inverse=True)
            who = number.reshape(-1)[doc].astype(np.uint32)
            order = np.lexsort((at, who, gram))
            order = order[~same_as_before(gram[order], who[order], at[order])]
            gram, who, at, context = gram[order], who[order], at[order], context[order]
            first = np.flatnonzero(~same_as_before(gram))
            places = np.diff(np.append(first, len(gram)))
            several = np.flatnonzero(np.repeat(places > 1, places))
            # Of a gram that is here at several places, only the number of its contexts goes on.
            kinds = np.zeros(len(first), np.uint32)
            own = several[np.lexsort((context[several], gram[several]))]
            differs = ~same_as_before(gram[own], context[own])
            kinds[places > 1] = np.add.reduceat(differs, np.flatnonzero(~same_as_before(gram[own]))) if len(own) else 0
            done: dict[int, list] = {}
            for row in _points(table[who[several], 0], table[who[several], 1], gram[several], at[several]):
                done.setdefault(row[0] % buckets, []).append(row)
            sent = dict(parts((gram[first] % _U(buckets)).astype(np.int64), buckets))
            rows = []
            for b in sorted(sent.keys() | done.keys()):
                own = first[sent.get(b, first[:0])]
                some, number = np.unique(who[own], return_inverse=True)
                rows.append((b, pickle.dumps((gram[own], table[some], number.astype(np.uint32), at[own], kinds[sent.get(b, first[:0])], done.get(b, [])), 5)))
            yield from packed_rows(rows)

        for batch in common.slices(batches, "text", 1 << 20):
            ids.append(batch.column(0).to_numpy())
            ties.append(batch.column(1).to_numpy())
            for doc, at, gram, context in find(*units(batch.column(2)), shape):
                held.append((doc + docs_held, at.astype(np.uint32), gram, context))
                anchors_held += len(at)
            docs_held += len(batch)
            if anchors_held >= HELD:
                yield from pack()
                held, ids, ties, docs_held, anchors_held = [], [], [], 0, 0
        if anchors_held:
            yield from pack()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in by_bucket(batches):
            columns, rows = [], []
            for packed in bucket:
                gram, table, number, at, kinds, done = pickle.loads(packed)
                columns.append((gram, table[number, 0], table[number, 1], at, kinds))
                rows += done
            gram, doc_id, tie, at, kinds = (np.concatenate(c) for c in zip(*columns, strict=True))
            order = np.lexsort((at, tie, doc_id, kinds, gram))
            gram, doc_id, tie, at, kinds = (c[order] for c in (gram, doc_id, tie, at, kinds))
            own = ~(same_as_before(gram, kinds, doc_id, tie, at) & (kinds == 0))
            gram, doc_id, tie, at, kinds = (c[own] for c in (gram, doc_id, tie, at, kinds))
            first = np.flatnonzero(~same_as_before(gram))
            if len(first):
                entries = np.diff(np.append(first, len(gram)))
                open_ = (entries > 1) | (np.maximum.reduceat(kinds, first) > 0)
                left = np.flatnonzero(np.repeat(open_, entries) & (kinds == 0))
                rows += _points(doc_id[left], tie[left], gram[left], at[left])
                contexts = np.add.reduceat(np.maximum(kinds, 1).astype(np.int64), first)
                rows += [(int(g), int(n), MANY, b"") for g, n in zip(gram[first[contexts >= hot]].view(np.int64), contexts[contexts >= hot], strict=True)]
            yield from found_rows(rows)

    sent = common.in_arrow(identity(docs), scan, "bucket int, packed binary")
    return common.settle(common.in_arrow(dealt(sent), gather, FOUND), "anchors")


def hot_grams(found: DataFrame) -> frozenset[int]:
    """Grams with so many contexts that their groups are split: 10,000 at most."""
    many = found.where(F.col("kind") == MANY)
    total = many.agg(F.sum("tie")).first()[0]
    if total is None:
        return frozenset()
    rows = many.where(F.col("tie") > total // HOT_SHARE).select("doc_id").collect()
    return frozenset(r[0] & (1 << 64) - 1 for r in rows)


def read_contexts(units, points: np.ndarray, shape: Shape, hot: frozenset[int], join) -> Iterator[tuple[int, int, int, object]]:
    """(key, place, units before it, context) of each point of a document whose `units` can be sliced.

    join: makes a slice a hashable context, as bytes.
    """
    from xxhash import xxh3_64_intdigest

    for gram, at in points.tolist():
        low = max(0, at - shape.before)
        context = join(units[low : at + shape.window])
        if gram not in hot:
            yield gram, at, at - low, context
            continue
        for k, (before, after) in enumerate(shape.key_ranges()):
            if at - before >= 0 and at + after <= len(units):
                yield xxh3_64_intdigest(join(units[at - before : at + after]), gram ^ k), at, at - low, context


def squeezed(docs: DataFrame, *also: str) -> DataFrame:
    """identity(docs) with the text compressed, for shuffling: doc_id, tie, packed."""
    rows = identity(docs, *also)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        engine = zstandard.ZstdCompressor(level=1)
        for batch in common.slices(batches, "text"):
            raw = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            packed = pa.array([engine.compress(x.as_buffer()) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, *batch.columns[3:]], names=["doc_id", "tie", "packed", *batch.schema.names[3:]])

    kind = rows.select("doc_id", "tie", F.lit(None).cast("binary").alias("packed"), *rows.columns[3:]).schema
    return common.in_arrow(rows, work, kind)


def of_kind(found: DataFrame, kind: int, name: str) -> DataFrame:
    """doc_id, tie and the list of that kind's data of each document."""
    return found.where(F.col("kind") == kind).groupBy("doc_id", "tie").agg(F.collect_list("data").alias(name))


def cover(docs: DataFrame, covered: DataFrame, finish, schema: str, *also: str) -> DataFrame:
    """finish(text bytes, merged ranges as an int64 array of pairs) -> values of `schema`, for every row of docs.

    Gives doc_id, those values, and the columns `also` of docs.
    """
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    targets = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        engine = zstandard.ZstdDecompressor()
        for whole in batches:
            for low in range(0, len(whole), 500):
                batch, rows = whole.slice(low, 500), []
                for packed, own in zip(batch.column("packed"), batch.column("ranges").to_pylist(), strict=True):
                    pairs = np.frombuffer(b"".join(own or []), "<i4").reshape(-1, 2).astype(np.int64)
                    rows.append(finish(engine.decompress(packed.as_buffer()), merged(pairs[:, 0], pairs[:, 1]) if len(pairs) else pairs))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), targets, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *([batch.column("rest")] if also else [])], names=["doc_id", *names, *(["rest"] if also else [])])

    joined = squeezed(docs, *also).join(of_kind(covered, COVERED, "ranges"), ["doc_id", "tie"], "left")
    kind = joined.select("doc_id", *(F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)), *(["rest"] if also else [])).schema
    done = common.in_arrow(joined, work, kind)
    return done.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), *names, *(F.col(f"rest.`{c}`").alias(c) for c in also))
