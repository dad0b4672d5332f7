"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by 80 % or more, and the groups that they form.

Equal sets are one vertex. A set's rarest shingles (a prefix of about a fifth, in an order by a fixed-size table of corpus counts)
are dealt out into index lists. Two sets that link share a prefix shingle; in the list of the first that they share, sizes and
positions must allow the overlap. A list is sorted by size and position, so each scan skips whole blocks that can't.

Answers are derived by set relations. Each list first compares its sets with one of them only, its centre, which gives each
set's difference from the centre. Sets that link to the centre are in one group, and need no comparison with each other. For sets
of different groups that were compared with the same centre c, |x & y| = |c| - |c - x| - |c - y| + |dx & dy|, where dx and dy
are the differences from c: their overlap follows from c's answers and two short lists. Only sets without a common centre are
compared in full. Every answer is that of whole sets.

Words are lower-cased (A-Z) runs of bytes other than \\x20 and \\x09-\\x0D; a text of fewer than 5 words has one shingle, and
one without words has none and links with nothing. Shingles are compared by 64-bit hashes. Null doc_ids take part, but
are never the smallest of a group with others. Repeated rows link like equal texts. An empty table has no rows and no groups. Other
columns, whatever their names, aren't read; `one_of_each` gives them back.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, common
from .components import components

WORDS = 5
#: log2 of the number of counters of the count table (a byte each once counted).
COUNTERS = 18
SLICES = 16
#: Lists of up to so many sets emit all pairs that sizes and positions allow; longer ones wait for the groups.
SHORT_LIST = 16
#: A list of more entries in one task is dealt with there first.
LONG_IN_TASK = 256
#: Sets of a long list, or of those compared with one centre, that are in one block; a set counts once more for each
#: DIFFERENCE bytes of its difference.
BLOCK, DIFFERENCE = 256, 8_000
NO_ID = (1 << 63) - 1
_U = np.uint64


class Shingles:
    def __init__(self) -> None:
        self.hashes = common.WordHashes()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        lists = [t.lower().split() for t in texts]
        units = self.hashes.of([w for x in lists for w in x])
        rolling = anchors.Rolling(units)
        grams = common.mix(rolling.grams(WORDS))
        out, at = [], 0
        for x in lists:
            n = len(x)
            if n >= WORDS:
                out.append(np.unique(grams[at : at + n - WORDS + 1]))
            elif n:
                out.append(common.mix(rolling.span(np.array([at]), np.array([at + n])) ^ _U(n)))
            else:
                out.append(np.zeros(0, _U))
            at += n
        return out


def needed(n, m):
    """The smallest overlap of sets of n and m shingles with 100 * overlap >= 80 * union."""
    return -(-4 * (n + m) // 9)


def prefix_size(n: int) -> int:
    return n + (-8 * n // 10) + 1


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())]


def count_levels(docs: DataFrame) -> np.ndarray:
    """How common each of 2^COUNTERS classes of shingles is, over all documents, as a logarithmic level."""
    size = (1 << COUNTERS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(), np.zeros(1 << COUNTERS, np.int64)
        for batch in common.slices(batches, "text", 2 << 20):
            own = np.concatenate([np.zeros(0, _U), *shingles.sets(_texts(batch.column(0)))])
            total += np.bincount((own >> _U(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        parts = total.reshape(SLICES, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(raw.as_buffer(), "<i8")
        rows = [(k, (8 * np.log2(v + 1)).clip(0, 255).astype(np.uint8).tobytes()) for k, v in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "levels"])

    counted = common.in_arrow(docs.select("text"), count, "slice int, counts binary").repartition(SLICES, "slice")
    levels = np.zeros((SLICES, size), np.uint8)
    for row in common.in_arrow(counted, add, "slice int, levels binary").collect():  # 2^COUNTERS bytes, whatever the input
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


_ROWS = "doc_id long, id long, tie long, n long, hi long, lo long, prefix binary"


def signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, its set's size, digest and prefix (rarest first) of every row. A written table."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, table = Shingles(), held.value
        for batch in common.slices(batches, "text", 2 << 20):
            sizes, highs, lows, prefixes = [], [], [], []
            for own in shingles.sets(_texts(batch.column(3))):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                order = np.argsort(table[(own >> _U(64 - COUNTERS)).astype(np.int64)], kind="stable")
                sizes.append(len(own))
                highs.append(int.from_bytes(digest[:8], "little", signed=True))
                lows.append(int.from_bytes(digest[8:], "little", signed=True))
                prefixes.append(own[order[: prefix_size(len(own))]].astype("<u8").tobytes() if len(own) else b"")
            new = [pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["doc_id", "id", "tie", "n", "hi", "lo", "prefix"])

    return common.settle(common.in_arrow(rows, work, _ROWS), "signatures")


_PAIR = np.dtype([("a", "<i8"), ("at", "<i8"), ("b", "<i8"), ("bt", "<i8")])
STAR, SHORT, LONG = 0, 1, 2
_LISTED = "kind int, gram long, a_id long, a_tie long, b_id long, b_tie long, n long, at long"


def _listed(kind: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _LISTED.split(", ")]
    n = len(columns["a_id"])
    zero = np.zeros(n, np.int64)
    for low in range(0, n, 50_000):
        own = [pa.array(np.full(n, kind, np.int32)[low : low + 50_000])] + [pa.array(columns.get(c, zero)[low : low + 50_000].astype(np.int64)) for c in names[1:]]
        yield pa.RecordBatch.from_arrays(own, names=names)


def _unique_pairs(a_id, a_tie, b_id, b_tie) -> dict[str, np.ndarray]:
    pairs = np.unique(np.rec.fromarrays([a_id, a_tie, b_id, b_tie], dtype=_PAIR)) if len(a_id) else np.zeros(0, _PAIR)
    return {"a_id": pairs["a"], "a_tie": pairs["at"], "b_id": pairs["b"], "b_tie": pairs["bt"]}


class _Entries:
    """Entries of index lists as columns, by gram, then size and position. long: whether the entry stands for a long list."""

    names = ("gram", "id", "tie", "n", "at", "long")

    def __init__(self, columns: list[np.ndarray]):
        order = np.lexsort((columns[4], columns[3], columns[0]))
        self.gram, self.id, self.tie, self.n, self.at, self.long = (c[order] for c in columns)
        self.first = np.searchsorted(self.gram, self.gram)
        self.size = np.searchsorted(self.gram, self.gram, "right") - self.first
        # The centre is the smallest set by id, so that lists of the same sets have the same one.
        self.centre = np.lexsort((self.tie, self.id, self.gram))[self.first]

    def take(self, rows: np.ndarray) -> list[np.ndarray]:
        return [getattr(self, c)[rows] for c in self.names]

    def star(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a list's centre with those of its other sets that may link to it."""
        centre = self.centre[rows]
        may = _may_link(self.n, self.at, centre, rows) & (centre != rows)
        rows, centre = rows[may], centre[may]
        yield from _listed(STAR, _unique_pairs(self.id[centre], self.tie[centre], self.id[rows], self.tie[rows]))

    def entries(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        centre = self.centre[rows]
        columns = {"gram": self.gram[rows].view(np.int64), "a_id": self.id[rows], "a_tie": self.tie[rows], "b_id": self.id[centre], "b_tie": self.tie[centre], "n": self.n[rows], "at": self.at[rows]}
        yield from _listed(LONG, columns)

    def short(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All pairs without the centre that sizes and positions allow, of lists of `SHORT_LIST` entries at most."""
        found = [[np.zeros(0, np.int64)] * 4]
        for step in range(1, SHORT_LIST):
            a = rows[rows + step < self.first[rows] + self.size[rows]]
            if not len(a):
                break
            b = a + step
            good = _may_link(self.n, self.at, a, b) & (self.centre[a] != a) & (self.centre[a] != b)
            a, b = a[good], b[good]
            flip = (self.id[a] > self.id[b]) | ((self.id[a] == self.id[b]) & (self.tie[a] > self.tie[b]))
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            found.append([self.id[a], self.tie[a], self.id[b], self.tie[b]])
        yield from _listed(SHORT, _unique_pairs(*(np.concatenate([f[k] for f in found]) for k in range(4))))


_SENT = "bucket int, packed binary, " + _LISTED


def _beside(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LISTED as rows of _SENT, dealt anywhere."""
    for batch in rows:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(2).to_numpy() % 1024 - 1024, pa.int32()), pa.nulls(n, pa.binary()), *batch.columns], names=["bucket", "packed", *batch.schema.names])


def lists(vertices: DataFrame) -> DataFrame:
    """From vertices(id, tie, n, prefix): STAR and SHORT pairs that may link, and the entries of LONG lists. A written table.

    A list that is long within a task already has a centre of its own there, and only that centre goes on.
    """
    tasks = common.tasks(vertices)
    buckets = 4 * tasks
    names = [c.split()[0] for c in _LISTED.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def pack() -> Iterator[pa.RecordBatch]:
            ids, ties, sizes = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:3])
            lengths = np.array([len(r[3]) for r in rows])
            who = np.repeat(np.arange(len(rows)), lengths)
            at = np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = _Entries([np.concatenate([r[3] for r in rows]), ids[who], ties[who], sizes[who], at, np.zeros(len(who), bool)])
            long = own.size > LONG_IN_TASK
            here = np.flatnonzero(long)
            yield from _beside(own.star(here))
            yield from _beside(own.entries(here))
            own.long = long
            left = own.take(np.flatnonzero(~long | (own.centre == np.arange(len(long)))))
            made = [(b, pickle.dumps([c[part] for c in left], 5)) for b, part in anchors.parts((left[0] % _U(buckets)).astype(np.int64), buckets)]
            for batch in anchors.packed_rows(made):
                n = len(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 7], names=["bucket", "packed", *names])

        for batch in batches:
            for id_, tie, n, prefix in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append((id_, tie, n, np.frombuffer(prefix, "<u8")))
                held += len(prefix) // 8
                if held >= 1_000_000:
                    yield from pack()
                    rows, held = [], 0
        if rows:
            yield from pack()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                beside = pc.is_null(batch.column("packed"))
                done = batch.filter(beside)
                if len(done):
                    passing.append(done.select(names))
                yield batch.filter(pc.invert(beside))

        passing: list[pa.RecordBatch] = []
        for bucket in anchors.by_bucket(packed()):
            own = _Entries([np.concatenate(c) for c in zip(*map(pickle.loads, bucket), strict=True)])
            own = _Entries(own.take(np.flatnonzero((own.size > 1) | own.long)))
            rows = np.arange(len(own.gram))
            long = (own.size > SHORT_LIST) | (np.add.reduceat(own.long.astype(np.int64), np.unique(own.first)) > 0)[np.cumsum(own.first == rows) - 1] if len(rows) else np.zeros(0, bool)
            yield from own.star(rows)
            yield from own.short(rows[~long & (own.size > 2)])
            yield from own.entries(rows[long])
            yield from passing
            passing.clear()
        yield from passing

    sent = common.in_arrow(vertices.select("id", "tie", "n", "prefix"), deal, _SENT).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return common.settle(common.in_arrow(sent, gather, _LISTED), "lists")


def _may_link(n: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets that share their first shingle at these positions can overlap enough."""
    return np.minimum(n[a] - at[a], n[b] - at[b]) >= needed(n[a], n[b])


_VERIFIED = "a struct<id: long, tie: long>, b struct<id: long, tie: long>, overlap long, n long, m long, apart binary"


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Overlap and sizes of the sets of pairs(a, b); texts(v, packed) has the text of each vertex. A written table.

    apart: what only one of the two has, if the sets are half alike at least.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        engine, shingles = zstandard.ZstdDecompressor(), Shingles()
        last: list = [None, None]
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                left, right = part.column(2), part.column(3)
                own = shingles.sets([engine.decompress(x.as_buffer()) for x in right])
                rows = []
                for x, b in zip(left, own, strict=True):
                    raw = x.as_buffer().to_pybytes()
                    if raw != last[0]:
                        last = [raw, shingles.sets([engine.decompress(raw)])[0]]
                    apart = np.setxor1d(last[1], b, assume_unique=True)
                    overlap = (len(last[1]) + len(b) - len(apart)) // 2
                    rows.append((overlap, len(last[1]), len(b), apart.astype("<u8").tobytes() if len(apart) <= overlap else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["a", "b", "overlap", "n", "m", "apart"])

    named = lambda v: texts.select(F.col("v").alias(v), F.col("packed").alias(f"{v}_text"))
    joined = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "a_text", "b_text")
    return common.settle(common.in_arrow(joined, work, _VERIFIED), "compared")


def _linked() -> Column:
    return 180 * F.col("overlap") >= 80 * (F.col("n") + F.col("m"))


def in_cells(rows: DataFrame, key: str, root: str, each: Column, size: Column) -> DataFrame:
    """Deal the rows of each key that has several roots into cells, so that any two of different roots meet in one.

    Rows of the key's largest root are in blocks of some `BLOCK` by `size`, and so are the others; a cell has a block of the one
    and a block of the other, or two blocks of the others. Adds cell, side and whole: rows of a cell are to be compared if
    they are on different sides, or all of them if it is whole. `each` tells a key's rows apart.
    """
    own = rows.groupBy(key, root).agg(F.sum(size).alias("size"))
    sums = own.groupBy(key).agg(F.sum("size").alias("total"), F.max(F.struct("size", root)).alias("top")).where(F.col("top.size") < F.col("total"))
    count = lambda size: F.ceil(size / BLOCK).cast("int")
    sums = sums.select(key, F.col(f"top.{root}").alias("top"), count(F.col("top.size")).alias("tops"), count(F.col("total") - F.col("top.size")).alias("others"))
    dealt = rows.join(common.settle(sums, "cells"), key)
    is_top = F.col(root) == F.col("top")
    block = F.pmod(F.xxhash64(each), F.when(is_top, F.col("tops")).otherwise(F.col("others"))).cast("int")
    cell = lambda x, y, side, whole: F.struct(x.alias("x"), y.alias("y"), side.alias("side"), whole.alias("whole"))
    zero, no = F.lit(0), F.lit(False)
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    with_tops = F.transform(upto("tops"), lambda x: cell(x, F.col("block"), F.lit(1), no))
    with_others = F.transform(upto("others"), lambda y: cell(-1 - F.least(y, "block"), F.greatest(y, "block"), F.col("block"), y == F.col("block")))
    cells = F.when((F.col("tops") == 1) & (F.col("others") == 1), F.array(cell(zero, zero, zero, F.lit(True))))
    cells = cells.when(is_top, F.transform(upto("others"), lambda y: cell(F.col("block"), y, zero, no))).otherwise(F.concat(with_tops, with_others))
    dealt = dealt.withColumn("block", block).withColumn("cell", F.explode(cells))
    return dealt.select(*rows.columns, F.struct(key, "cell.x", "cell.y").alias("cell"), "cell.side", "cell.whole")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one cell after another, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cells = batch.column("cell").to_pylist()
        edges = [0, *(k for k in range(1, len(cells)) if cells[k] != cells[k - 1]), len(cells)]
        for low, high in zip(edges, edges[1:], strict=False):
            if held and held[0].column("cell")[0].as_py() != cells[low]:
                yield _one(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield _one(held)


class _Merged:
    """Labels that have been found to be one."""

    def __init__(self) -> None:
        self.to: dict[int, int] = {}

    def of(self, x: int) -> int:
        while x in self.to:
            x = self.to[x]
        return x


_LINK = "a_id long, a_tie long, b_id long, b_tie long"


def derived_links(members: DataFrame) -> DataFrame:
    """Links between different groups among sets compared with one centre, from their differences to it.

    members(a, b, n, m, overlap, apart, b_root): centre a, set b. At most one link per set and group of a cell is given.
    """

    def links(rows: pa.RecordBatch) -> list[tuple[int, int, int, int]]:
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        who = list(zip(rows.column("b").field(0).to_pylist(), rows.column("b").field(1).to_pylist(), strict=True))
        centre, n, root, side = int(column("n")[0]), column("m"), column("b_root"), column("side")
        lost = centre - column("overlap")
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("apart")]
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        values, element = np.unique(np.concatenate(parts), return_inverse=True)
        holder = np.repeat(np.arange(len(parts)), lengths)[np.argsort(element, kind="stable")]
        bounds = np.append(0, np.cumsum(np.bincount(element, minlength=len(values))))
        if column("whole")[0]:
            labels, times = np.unique(root, return_counts=True)
            asking, other = root != labels[times.argmax()], np.ones(len(who), bool)
        else:  # the smaller side asks
            sides, times = np.unique(side, return_counts=True)
            asking = side == sides[times.argmin()] if len(sides) > 1 else np.zeros(len(who), bool)
            other = ~asking
        merged, out = _Merged(), []
        for x in np.flatnonzero(asking).tolist():
            own = element[ends[x] - lengths[x] : ends[x]]
            low, count = bounds[own], bounds[own + 1] - bounds[own]
            at = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()) if len(own) else own
            overlap = centre - lost[x] - lost + np.bincount(holder[at], minlength=len(who))
            near = np.flatnonzero((180 * overlap >= 80 * (n[x] + n)) & (root != root[x]) & other)
            for y in near[np.unique(root[near], return_index=True)[1]].tolist():
                a, b = merged.of(int(root[x])), merged.of(int(root[y]))
                if a != b:
                    merged.to[max(a, b)] = min(a, b)
                    out.append((*who[x], *who[y]))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            found = links(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], names=["a_id", "a_tie", "b_id", "b_tie"])

    rows = members.select("a", "b", "n", "m", "overlap", "apart", "b_root")
    rows = in_cells(rows, "a", "b_root", F.col("b"), 1 + F.length("apart") / DIFFERENCE)
    rows = rows.repartition(common.tasks(members), "cell").sortWithinPartitions("cell", "b")
    return common.in_arrow(rows, work, _LINK)


def _across(entries: DataFrame) -> DataFrame:
    """Pairs of LONG lists' entries in different groups, without a common centre, that sizes, positions and distances allow."""

    def pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        id_, tie, root, home, n, at, side = (rows.column(c).to_numpy() for c in ("id", "tie", "root", "home", "n", "at", "side"))
        centre, far = rows.column("centre").to_numpy(), rows.column("far").to_numpy(zero_copy_only=False)
        far = np.where(np.isnan(far), np.inf, far)
        whole = rows.column("whole")[0].as_py()
        alone = np.arange(len(n))
        for a in range(len(n) - 1):
            rest = alone[a + 1 :]
            rest = rest[: np.searchsorted(n, n[a] * 5 // 4 + 1, "right") - a - 1]  # larger blocks can't link
            good = (root[rest] != root[a]) & (home[rest] != home[a]) & (np.minimum(n[a] - at[a], n[rest] - at[rest]) >= needed(n[a], n[rest]))
            if not whole:
                good &= side[rest] != side[a]
            known = (centre[rest] == centre[a]) & np.isfinite(far[rest]) & np.isfinite(far[a])
            with np.errstate(invalid="ignore"):
                good &= ~known | (np.abs(far[rest] - far[a]) <= 0.2 + 1e-9)
            rest = rest[good]
            if len(rest):
                one = np.full(len(rest), id_[a]), np.full(len(rest), tie[a])
                flip = (one[0] > id_[rest]) | ((one[0] == id_[rest]) & (one[1] > tie[rest]))
                cols = [np.where(flip, id_[rest], one[0]), np.where(flip, tie[rest], one[1]), np.where(flip, one[0], id_[rest]), np.where(flip, one[1], tie[rest])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a_id", "a_tie", "b_id", "b_tie"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            yield from pairs(rows)

    rows = in_cells(entries, "gram", "root", F.struct("id", "tie"), F.lit(1))
    rows = rows.repartition(common.tasks(entries), "cell").sortWithinPartitions("cell", "n", "at", "id", "tie")
    return common.in_arrow(rows, work, _LINK)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _vertex(name: str) -> Column:
    return F.struct(F.col(f"{name}_id").alias("id"), F.col(f"{name}_tie").alias("tie")).alias(name)


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all rows, vertices (v, hi, lo), links between vertices (a, b) that make up their groups)."""
    rows = signatures(docs, count_levels(docs))
    vertices = rows.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct("id", "tie")).alias("v"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    vertices = common.settle(vertices, "vertices")
    listed = lists(vertices.select("v.id", "v.tie", "n", "prefix"))
    star = listed.where(F.col("kind") == STAR).select(_vertex("a"), _vertex("b")).distinct()
    short = listed.where(F.col("kind") == SHORT).select(_vertex("a"), _vertex("b")).distinct()
    long = listed.where(F.col("kind") == LONG)
    in_lists = listed.select(_vertex("a")).unionByName(listed.select(_vertex("b").alias("a"))).distinct().select(F.col("a.id").alias("doc_id"), F.col("a.tie").alias("tie"))
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    texts = anchors.squeezed(own).join(in_lists, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    texts = common.settle(texts.select(F.struct(F.col("doc_id").alias("id"), "tie").alias("v"), "packed"), "texts")
    first = compare(star, texts)
    links = first.where(_linked())
    groups = components(links)
    # Pairs of sets that were compared with the same centre and are in different groups.
    label = lambda v: F.xxhash64(v)
    root = lambda v: groups.select(F.col("v").alias(v), label("root").alias(f"{v}_root"))
    rooted = lambda df: df.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns({f"{v}_root": F.coalesce(f"{v}_root", label(v)) for v in "ab"})
    derived = derived_links(rooted(first.where("apart is not null")).select("a", "b", "n", "m", "overlap", "apart", "b_root")).select(_vertex("a"), _vertex("b"))
    # What is left: pairs of lists without a common centre. A set's home is the smallest centre that is half like it.
    centres = first.select(F.col("a").alias("v"), F.col("a").alias("home")).distinct()
    homes = first.where("apart is not null").select(F.col("b").alias("v"), F.col("a").alias("home")).unionByName(centres)
    homes = common.settle(homes.groupBy("v").agg(label(F.min("home")).alias("home")), "homes")
    home = lambda v: homes.select(F.col("v").alias(v), F.col("home").alias(f"{v}_home"))
    open_ = rooted(short).where("a_root <> b_root").join(home("a"), "a", "left").join(home("b"), "b", "left")
    open_ = open_.where(F.coalesce("a_home", label("a")) != F.coalesce("b_home", label("b"))).select("a", "b")
    far = first.select(F.col("a").alias("centre"), F.col("b").alias("v"), (1 - F.col("overlap") / (F.col("n") + F.col("m") - F.col("overlap"))).alias("far"))
    entries = long.select("gram", _vertex("a"), _vertex("b"), "n", "at").select("gram", F.col("a").alias("v"), F.col("b").alias("centre"), "n", "at")
    entries = entries.join(groups, "v", "left").join(homes, "v", "left").join(far, ["centre", "v"], "left")
    entries = entries.select(
        "gram", "v.id", "v.tie", "n", "at", label(F.coalesce("root", "v")).alias("root"), F.coalesce("home", label("v")).alias("home"),
        label("centre").alias("centre"), F.when(F.col("v") == F.col("centre"), 0.0).otherwise(F.col("far")).cast("double").alias("far"),
    )
    across = _across(entries).select(_vertex("a"), _vertex("b")).distinct()
    seen = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = compare(open_.unionByName(across).distinct().join(seen, ["a", "b"], "left_anti"), texts)
    return rows, vertices.select("hi", "lo", "v"), links.select("a", "b").unionByName(derived).unionByName(second.where(_linked()).select("a", "b"))


def group(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, component_id and stays of every row of docs(doc_id, text).

    stays: whether the row is the smallest document of its group (by doc_id, then tie).
    """
    rows, vertices, links = join(docs)
    groups = components(links)
    roots = vertices.join(groups, "v", "left").select("hi", "lo", F.coalesce("root", "v").alias("root"))
    rows = rows.select("doc_id", "id", "tie", "n", "hi", "lo")
    empty = rows.where("n = 0").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    stays = (F.col("id") == F.col("root.id")) & (F.col("tie") == F.col("root.tie"))
    full = rows.where("n > 0").join(roots, ["hi", "lo"]).select("doc_id", "tie", F.col("n").alias("n_shingles"), F.nullif("root.id", F.lit(NO_ID)).alias("component_id"), stays.alias("stays"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each group (of rows that repeat whole, one)."""
    own = common.settle(group(docs).where("stays").groupBy("doc_id", "tie").agg(F.count("*").alias("copies")), "staying")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    left = docs.join(own, docs["doc_id"].eqNullSafe(own["doc_id"]) & (text == own["tie"]), "left_semi")
    if own.where("copies > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.read(spark, sf_dir, "documents")).drop("tie", "stays")


QUERY = ("op4_jaccard_join", query, None)
