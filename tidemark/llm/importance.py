"""Importance resampling: documents are drawn in proportion to how likely the target's words make them.

Features are runs of words, hashed into buckets. A bucket's gain is the logarithm of how much more often the target (the
benchmark) has it than the documents, both counts raised by one. A document's weight is the mean gain of its features, and
Gumbel noise from a digest of its id turns the highest scores into a draw without replacement.

Three passes: the buckets of all texts are counted (a task sends one row a bucket at most); the gains, one array of `buckets`
numbers, go to every task, which looks up each feature's gain and writes the scores as a table; the cutoff is then found on
that table by bisection. A bisection job counts exactly how many rows lie at or below several thresholds at once, first of the score,
then, among the rows of the cutoff's score, of doc_id, and so on through `ORDER`, until the drawn number is met. No job sorts all
rows. Only the drawn ones are range-partitioned, and a row's rank is its place in its partition after the partitions before it.

Null and empty texts have no features: weight 0, never drawn where `least_words` is over 0. A null doc_id has the digest of an
empty id and ranks as the smallest. Rows that repeat are rows of their own: of ones that agree in score and doc_id the one with fewer
features ranks first, and any order of rows that agree in this too gives the same result. An empty table gives an empty
result; with an empty benchmark all gains come from the documents alone. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Thresholds that a bisection job counts at once.
SECTIONS = 16
#: Longest feature, in bytes, whose checksum is made along with others.
_TOGETHER = 48
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased: digits, letters, all that isn't ASCII.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each data[start:end]: byte by byte for all short runs together, one by one for long ones."""
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, _TOGETHER + 1).astype(np.uint8), kind="stable")[::-1]  # longest first
    at, n = starts[order], np.bincount(np.minimum(sizes, _TOGETHER + 1), minlength=_TOGETHER + 2)
    many = np.cumsum(n[::-1])[::-1]  # many[k]: runs of k bytes or more
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(int(min(sizes.max(initial=0), _TOGETHER))):
        live = crc[: many[k + 1]]
        live[:] = _STEPS[(live ^ data[at[: many[k + 1]] + k]) & 0xFF] ^ (live >> 8)
    crc = ~crc
    for k in range(many[_TOGETHER + 1]):
        crc[k] = zlib.crc32(data[at[k] : ends[order[k]]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, the row it belongs to, number of words of every row)."""
    data, bounds = common.bytes_of(texts)
    data = np.append(_LOWER[data], np.uint8(32))
    inside = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    cuts = np.unique(bounds[(bounds > 0) & (bounds < len(data) - 1)])  # words also end where a text does
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    edge = np.sort(np.concatenate([[0] if inside[0] else [], edge, cuts, cuts]).astype(np.int64))
    starts, ends = edge[::2], edge[1::2]
    rows = np.searchsorted(bounds, starts, "right") - 1
    n_words = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    if longest > 1:  # runs of words are joined by one space: the words' bytes are copied with one space after each
        sizes = ends - starts
        to = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
        joined[np.repeat(to - starts, sizes) + np.flatnonzero(inside)] = data[inside]
        data, starts, ends = joined, to, to + sizes
    found, owners = [], []
    for n in range(1, longest + 1):
        first = np.flatnonzero(rows[: max(0, len(rows) - n + 1)] == rows[n - 1 :])
        found.append(checksums(data, starts[first], ends[first + n - 1]))
        owners.append(rows[first])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of `texts` (text) fall into each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in common.slices(batches, "text"):
            found, _, _ = features(batch.column(0), longest, buckets)
            total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    each = common.in_arrow(texts.select("text"), work, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, as an array."""
    counted = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for held, texts in zip(counted, (docs, target), strict=True):
        for bucket, n in bucket_counts(texts, longest, buckets).collect():  # as many rows as buckets
            held[bucket] = n
    s, t = counted
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in common.slices(batches, "text"):
            found, rows, n_words = features(batch.column(1), longest, len(gain))
            n = np.bincount(rows, minlength=len(batch)).astype(np.int64)
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, rows, gain[found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    weighed = common.in_arrow(docs.select("doc_id", "text"), work, f"doc_id {id_type}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    even = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(even))))


#: What rows are drawn and ranked by, smallest first; `row` tells rows apart that agree in all others.
ORDER = ("down", "id", "n_features", "row")


def keyed(scored: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The scores with the columns of ORDER and `may`: whether a document can be drawn."""
    return scored.withColumns({"down": -F.col("score"), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "may": F.col("n_words") >= least_words, "row": F.monotonically_increasing_id()})


def _bisected(rows: DataFrame, key: str, wanted: int, sections: int) -> tuple[int, int, int]:
    """(v, below, upto): the smallest value v of `key` at or below which at least `wanted` rows lie, and how many lie below v and up to v."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below, upto = 0, None
    while low < high:
        marks = sorted({low + (high - low) * k // sections for k in range(sections)})
        counts = rows.where(F.col(key).between(low, high)).agg(*(F.count(F.when(F.col(key) <= m, True)) for m in marks), F.count(F.lit(1))).first()
        found = next((k for k, n in enumerate(counts) if below + n >= wanted))
        marks.append(high)
        high, upto = marks[found], below + counts[found]
        if found:
            low, below = marks[found - 1] + 1, below + counts[found - 1]
    return low, below, rows.where(F.col(key) <= low).count() if upto is None else upto


def cutoff(rows: DataFrame, wanted: int, keys: tuple[str, ...] = ORDER, sections: int = SECTIONS) -> Column:
    """The condition that exactly `wanted` of the rows meet, the smallest in the order of the keys."""
    if wanted <= 0:
        return F.lit(False)
    out, tied = F.lit(False), F.lit(True)
    for key in keys:
        value, below, upto = _bisected(rows.where(tied), key, wanted, sections)
        if upto == wanted:
            return out | (tied & (F.col(key) <= value))
        out, tied = out | (tied & (F.col(key) < value)), tied & (F.col(key) == value)
        wanted -= below
    return out | tied


def ranked(rows: DataFrame, keys: tuple[str, ...] = ORDER) -> DataFrame:
    """The rows with rank: 1, 2, 3... in the order of the keys. A written table.

    Partitions hold ranges of the order and are sorted each for itself; how many rows the partitions before it have is all that
    one needs to know.
    """
    n = common.tasks(rows)
    placed = common.settle(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("place", 33)
    before, starts = 0, []
    for number, count in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row a partition
        starts.append((number, before))
        before += count
    starts = rows.sparkSession.createDataFrame(starts, "part long, before long")
    own = F.col("before") + F.col("place").bitwiseAND(2**33 - 1) + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", own).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    table = common.settle(keyed(scores(docs, gains(docs, target, longest, buckets), longest, seed), least_words), "scores")
    may = table.where("may")
    drawn = F.col("may") & cutoff(may, percent * may.count() // 100)
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked(table.where(drawn)).select(*own, "rank").unionByName(table.where(~drawn).select(*own, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS k
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
f AS (SELECT k, unnest(ws) AS w FROM d),
v AS (SELECT w, {common.crc32_sql("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM b)),
s AS (SELECT bucket, count(*) AS n FROM f JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (w) GROUP BY bucket),
gain AS (
  SELECT q.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS bucket) q LEFT JOIN s ON s.bucket = q.bucket LEFT JOIN t ON t.bucket = q.bucket),
w AS (SELECT k, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN v USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (k)),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank FROM ranked
"""

QUERY = ("op13_importance_resampling", query, SQL)
