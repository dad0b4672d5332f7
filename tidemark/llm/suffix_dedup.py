"""Suffix-array dedup: remove bytes that lie in a string of 100 bytes which also starts earlier in the corpus.

`anchors` brings together the places where such strings can start to agree: each has a context of up to 168 bytes around the same
32 bytes. The contexts of a group are sorted twice by a mergesort, as suffixes from the anchor on and, mirrored, as suffixes
from the anchor back. Its comparisons find the common extension of two suffixes by binary search on prefix polynomial hashes, so a
comparison takes a logarithmic number of steps. The common extensions of neighbours are then compared byte by byte, so a
collision of hashes can't make different strings equal. A string of 100 bytes that starts some bytes before the anchor is the
same in two contexts if they are in one run of the first order and in one run of the second; of such contexts the earliest keeps it.

Equal contexts of a task are found by comparing their bytes before anything is sent, so a task sends each context once.
"Earlier" means a smaller doc_id (null is the smallest), or the same document and an earlier start. Null text is empty. Texts under 100
bytes lose nothing. Rows that share doc_id and text are one document; of one doc_id with different texts, a hash decides.
An empty table gives an empty result. Other columns, whatever their names, aren't read; `without_repeats` gives them back.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors, common

WINDOW, GRAM = 100, 32
SHAPE = anchors.Shape(WINDOW, GRAM)
#: Bytes of contexts that a task collects before it sends them, and that are sorted at once.
COLLECTED, SORTED = 24 << 20, 2 << 20
#: A 64-bit value for each byte.
VALUES = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def units_of():
    def units(column: pa.Array):
        data, starts = common.bytes_of(column)
        return VALUES[data], starts

    return units


class Suffixes:
    """Suffixes data[start:end] of concatenated contexts, compared by hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        rolling = anchors.Rolling(data, VALUES)
        self.sums, self.base, self.scale = rolling.sums, rolling.sums[starts], rolling.scale(starts)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of suffixes a and b, by binary search."""
        at, to = self.starts[a], self.starts[b]
        low, high = np.zeros_like(at), np.minimum(self.ends[a] - at, self.ends[b] - to)
        (base_a, scale_a), (base_b, scale_b) = ((self.base[x], self.scale[x]) for x in (a, b))
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.sums[at + middle] - base_a) * scale_a == (self.sums[to + middle] - base_b) * scale_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; equal ones by number."""
        n = self.common(a, b)
        at, to = self.starts[a] + n, self.starts[b] + n
        last = len(self.data) - 1
        x = np.where(at < self.ends[a], self.data[np.minimum(at, last)].astype(np.int16), -1)
        y = np.where(to < self.ends[b], self.data[np.minimum(to, last)].astype(np.int16), -1)
        return np.where(x == y, a < b, x < y)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes within each group (group: ascending numbers), all groups and runs at once."""
        order = np.arange(len(group))
        first = np.searchsorted(group, group)  # where each suffix's group starts
        size = np.searchsorted(group, group, "right") - first
        place = order - first
        width = 1
        while width < size.max(initial=0):
            run = place // width
            even = run % 2 == 0
            other = np.where(even, run + 1, run - 1) * width  # the neighbouring run starts here, within the group
            low, high = np.minimum(other, size), np.minimum(other + width, size)
            base = low.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                less = self.before(order[first[open_] + middle], order[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            to = first + np.where(even, run, run - 1) * width + (place - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def neighbours(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, each one's common extension with the one before; -1 where a group begins), byte by byte."""
        order = self.sort(group)
        extension = np.full(len(order), -1)
        inner = np.flatnonzero(anchors.same_as_before(group[order]))
        a, b = order[inner - 1], order[inner]
        extension[inner] = self._verified(a, b, self.common(a, b))
        return order, extension

    def _verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, rows: int = 5_000) -> np.ndarray:
        """The extensions, cut where the bytes themselves differ."""
        out = n.copy()
        last = len(self.data) - 1
        for low in range(0, len(a), rows):
            x, y, m = self.starts[a[low : low + rows], None], self.starts[b[low : low + rows], None], n[low : low + rows, None]
            step = np.arange(int(m.max(initial=0)))
            differ = (self.data[np.minimum(x + step, last)] != self.data[np.minimum(y + step, last)]) & (step < m)
            if differ.any():
                out[low : low + rows] = np.where(differ.any(1), differ.argmax(1), m[:, 0])
        return out


def repeated(data: np.ndarray, lows: np.ndarray, at: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units before, units after its anchor) that a context loses to earlier ones of its group; (0, 0): nothing.

    Contexts data[lows:ends] with the anchor at `at` are in corpus order within each group (ascending numbers).
    """
    n = len(group)
    order, right = Suffixes(data, at, ends).neighbours(group)
    mirrored, left = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - at, len(data) - lows).neighbours(group)
    to_right, to_left = np.empty(n, np.int64), np.empty(n, np.int64)
    to_right[order], to_left[mirrored] = np.arange(n), np.arange(n)
    # The longest extension that a context shares with any other is that of a neighbour.
    best = lambda x, place: np.maximum(x[place], np.append(x[1:], -1)[place])
    best_right, best_left = best(right, to_right), best(left, to_left)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(SHAPE.before + 1):
        rows = np.flatnonzero((best_left >= offset) & (best_right >= WINDOW - offset))
        if not len(rows):
            continue
        same_right, same_left = np.cumsum(right < WINDOW - offset), np.cumsum(left < offset)
        run = same_right[to_right[rows]] * (n + 1) + same_left[to_left[rows]]
        by = np.argsort(run, kind="stable")
        later = rows[by[anchors.same_as_before(run[by])]]
        before[later] = offset
        after[later] = np.maximum(after[later], WINDOW - offset)
    return before, after


def _collect(texts: DataFrame, hot: frozenset[int]) -> DataFrame:
    """Contexts dealt by key, from texts(doc_id, tie, packed, points): each once a task; a later equal one is found covered."""
    buckets = 4 * common.tasks(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        seen: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        gone, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            rows = []
            done = [(d % buckets, d, t, r) for d, t, r in anchors.ranges_by_document(*np.array(gone, np.int64).reshape(-1, 4).T)]
            keys = np.fromiter((k for k, _ in seen), np.uint64, len(seen))
            places = np.array(list(seen.values()), np.int64).reshape(-1, 4)
            contexts = [c for _, c in seen]
            sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
            for b, own in anchors.parts((keys % np.uint64(buckets)).astype(np.int64), buckets):
                raw = (keys[own], places[own], sizes[own], b"".join([contexts[k] for k in own.tolist()]))
                rows.append((b, packer.compress(pickle.dumps((raw, []), 5))))
            for low in range(0, len(done), 5000):
                rows.append((done[low][0], packer.compress(pickle.dumps((None, [x[1:] for x in done[low : low + 5000]]), 5))))
            yield from anchors.packed_rows(rows)

        for batch in batches:
            for doc_id, tie, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "packed", "points")), strict=True):
                points = np.unique(np.frombuffer(b"".join(own), anchors.POINT))
                text = opener.decompress(packed)
                for key, at, before, context in anchors.read_contexts(text, points, SHAPE, hot, bytes):
                    place = (doc_id, tie, at, before)
                    first = seen.get((key, context))
                    if first is None:
                        seen[key, context] = place
                        size += len(context) + 250
                    elif first != place:
                        if place < first:
                            seen[key, context] = place
                            place, first = first, place
                        gone.append((place[0], place[1], place[2] - place[3], place[2] - place[3] + len(context)))
                if size > COLLECTED:
                    yield from send()
                    seen.clear()
                    gone, size = [], 0
        if seen:
            yield from send()

    return common.in_arrow(texts, work, "bucket int, packed binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    opener = zstandard.ZstdDecompressor()
    for bucket in anchors.by_bucket(batches):
        columns, rows = [], []
        for packed in bucket:
            raw, done = pickle.loads(opener.decompress(packed))
            rows += [(d, t, anchors.COVERED, r) for d, t, r in done]
            if raw is not None:
                columns.append(raw)
        if columns:
            keys, places, sizes = (np.concatenate(c) for c in list(zip(*columns, strict=True))[:3])
            data = np.frombuffer(b"".join(c[3] for c in columns), np.uint8)
            del columns
            rows += [(d, t, anchors.COVERED, r) for d, t, r in _ranges(keys, places, sizes, data)]
        yield from anchors.found_rows(rows)


def _ranges(keys: np.ndarray, places: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Ranges to remove, from contexts that lie one after another in data; some groups at a time."""
    lows = np.cumsum(sizes) - sizes
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], keys))
    order = order[~anchors.same_as_before(keys[order], *places[order].T)]
    keys, places, sizes, lows = keys[order], places[order], sizes[order], lows[order]
    same = anchors.same_as_before(keys)
    several = np.flatnonzero(same | np.append(same[1:], False))
    keys, places, sizes, lows = keys[several], places[several], sizes[several], lows[several]
    edges = np.append(np.flatnonzero(~anchors.same_as_before(keys)), len(keys))
    total = np.append(0, np.cumsum(sizes))
    found, k = [], 0
    while k < len(edges) - 1:
        to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + SORTED, "right")) - 1)
        rows = slice(edges[k], edges[to])
        size, ends = sizes[rows], np.cumsum(sizes[rows])
        own = data[np.repeat(lows[rows] - (ends - size), size) + np.arange(int(ends[-1]))]
        group = np.cumsum(~anchors.same_as_before(keys[rows]))
        before, after = repeated(own, ends - size, ends - size + places[rows, 3], ends, group)
        hit = np.flatnonzero(after)
        at = places[rows, 2][hit]
        found.append((places[rows, 0][hit], places[rows, 1][hit], at - before[hit], at + after[hit]))
        k = to
    if found:
        yield from anchors.ranges_by_document(*(np.concatenate(c) for c in zip(*found, strict=True)))


def kept_bytes(text: bytes, ranges: np.ndarray) -> bytes:
    edges = [0, *ranges.reshape(-1).tolist(), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def removed(docs: DataFrame, hot: int = anchors.HOT) -> DataFrame:
    """(doc_id, tie, kind, data) rows with the ranges to remove of docs(doc_id, text). hot: contexts from which on a gram is split."""
    found = anchors.meet(docs, units_of, SHAPE, hot)
    texts = anchors.squeezed(docs).join(anchors.of_kind(found, anchors.POINTS, "points"), ["doc_id", "tie"])
    return common.in_arrow(anchors.dealt(_collect(texts, anchors.hot_grams(found))), _compare, anchors.FOUND)


def _digest(text: bytes, ranges: np.ndarray) -> tuple:
    return len(text), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), hashlib.sha256(kept_bytes(text, ranges)).hexdigest()


def dedup(docs: DataFrame, hot: int = anchors.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return anchors.cover(docs, removed(docs, hot), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _text(text: bytes, ranges: np.ndarray) -> tuple:
    """What is left as text: characters that a cut splits go as well."""
    left = kept_bytes(text, ranges).decode("utf-8", "ignore")
    return left, len(left), len(ranges)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text, and n_chars counted anew; texts of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = anchors.cover(docs, removed(docs), _text, "text string, n_chars long, n_cuts long", *others)
    return out.where("n_cuts = 0 or n_chars > 0").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents"))


QUERY = ("op8_suffix_dedup", query, None)
