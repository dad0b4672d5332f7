"""Best-fit packing of token pieces into sequences of a fixed capacity, by exact-complement hashing.

Only the number of pieces of each length matters, so packing plans on a histogram of at most `capacity` counts. A piece opens a
sequence; its gap is looked up in an index of single lengths, pair sums and triple sums, and the combinations that fill it
exactly are consumed as often as the counts allow: first each opener's exact complement, then pairs for the openers that
are left, then triples, longest opener first each time, even combinations before uneven ones, which would take long pieces. What
nothing completes is placed best-fit, longest first. Where lengths are few, exact pairs and triples can use up the short pieces
that best fit would need, so the plans with sums of up to three, two and one lengths are made, and the one with the
fewest sequences is taken. A plan is a list of patterns (lengths in a sequence, how many sequences); a piece finds its place
by its rank among all pieces of its length.

Ranks need no shuffle of documents: each task numbers its own pieces by length, and a table of counts by task and length
gives each task's first rank. Null text is an empty document (the end id alone); repeated doc_ids are packed each for itself.
An empty table has no pieces. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder as open_encoder

CAPACITY = 1024
END_ID = 2


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full pieces leave."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


class Sums:
    """Combinations of available lengths by their sum. Pair sums are indexed when they are first looked up; triples are a
    length and a pair."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}

    def pairs_of(self, total: int) -> list[tuple[int, int]]:
        """Pairs (longer, shorter) with this sum of lengths that were available at the first look-up, most even first."""
        if total not in self.pairs:
            short = np.arange(total // 2, 0, -1)
            short = short[(self.left[short] > 0) & (self.left[total - short] > 0)]
            self.pairs[total] = list(zip((total - short).tolist(), short.tolist(), strict=True))
        return self.pairs[total]

    def filling(self, gap: int, size: int) -> Iterator[tuple[int, ...]]:
        """Combinations of one, two or three lengths that fill the gap."""
        if size == 1:
            yield (gap,)
        elif size == 2:
            yield from self.pairs_of(gap)
        else:
            for x in range((gap + 2) // 3, gap - 1):
                if self.left[x]:
                    yield from ((x, a, b) for a, b in self.pairs_of(gap - x) if a <= x)


Patterns = list[tuple[tuple[int, ...], int]]


def exact_fills(left: np.ndarray, capacity: int, most: int = 3) -> Patterns:
    """Patterns of openers and combinations of up to `most` lengths that fill their gaps exactly; takes the pieces out of `left`."""
    made: Patterns = []
    sums = Sums(left)
    for size in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            if not left[length]:
                continue
            for rest in sums.filling(capacity - length, size):
                pattern = (length, *rest)
                times = min(int(left[x]) // n for x, n in Counter(pattern).items())
                if times:
                    for x in pattern:
                        left[x] -= times
                    made.append((pattern, times))
                if not left[length]:
                    break
    return made


def plan(counts: dict[int, int], capacity: int) -> Patterns:
    """Patterns (lengths, times) that together hold exactly `counts` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    whole: Patterns = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    plans = []
    for most in (3, 2, 1):
        rest = left.copy()
        plans.append(exact_fills(rest, capacity, most) + _best_fit(rest, capacity))
    return whole + min(plans, key=lambda made: sum(times for _, times in made))


def _best_fit(left: np.ndarray, capacity: int) -> Patterns:
    """Patterns of the remaining pieces, longest first into the tightest space; many equal pieces and sequences at a time."""
    free: dict[int, list[list]] = defaultdict(list)  # free space -> [[lengths, times]]
    for length in [x for x in range(capacity - 1, 0, -1) if left[x]]:
        n = int(left[length])
        while n:
            space = min((s for s, open_ in free.items() if s >= length and open_), default=None)
            if space is None:
                each = capacity // length
                if n >= each:
                    free[capacity - each * length].append([(length,) * each, n // each])
                if n % each:
                    free[capacity - n % each * length].append([(length,) * (n % each), 1])
                break
            lengths, times = free[space].pop()
            used = min(times, n)
            if times > used:
                free[space].append([lengths, times - used])
            free[space - length].append([(*lengths, length), used])
            n -= used
    return [(tuple(lengths), times) for open_ in free.values() for lengths, times in open_]


def slots(patterns: Patterns) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) rows: each place of a pattern takes a range of ranks."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return rows


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of docs(doc_id, text), numbered by length within its task (part, place). A written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = open_encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), Counter()
        for batch in common.slices(batches, "text", common.ENCODED):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return common.settle(common.in_arrow(docs.select("doc_id", "text"), work, _PIECES), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place the rows of `pieces` in sequences: adds sequence_id and offset."""
    spark = cut.sparkSession
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    placed = slots(plan(counts, capacity))
    # The rows of a length lie in its slots' rank ranges. Slots per length are few; those of one length travel as an array.
    by_length = defaultdict(list)
    for length, low, high, sequence, offset in placed:
        by_length[length].append((low, high, sequence, offset))
    table = spark.createDataFrame(list(by_length.items()), "length long, slots array<struct<low: long, high: long, sequence: long, offset: long>>")
    ranked = cut.join(F.broadcast(table), "length").join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("place"))
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), 1)
    return ranked.withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.sequence") + F.col("rank") - F.col("slot.low")).alias("sequence_id"), F.col("slot.offset").alias("offset")
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))


QUERY = ("op3_best_fit_packing", query, None)
