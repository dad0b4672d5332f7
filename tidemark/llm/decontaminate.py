"""Benchmark decontamination with one Aho-Corasick automaton over all benchmark windows.

Texts are lower-cased (A-Z) and split into words: runs of letters, digits and all that isn't ASCII. The benchmark's
distinct words get one letter of a private alphabet each, all other words share one letter that no pattern has, so a
document becomes a short string with a letter per word, scanned once. Hits are word ranges; `spans` maps them to character
offsets of the original text.

The automaton goes to every task, so a pass takes `most_words` words of benchmark text at most (a parameter). A larger benchmark
is scanned in several passes, each a written table that the next one reads, so that one automaton is in memory at a time; their
hits are united. An item of more words is split into parts that overlap by a window less one word, which have the same windows.

Null texts have no words; items without words have no windows. Items with a null id hit like others, but have no id to list or
count. Rows that share an item_id are one item. Repeated documents are scanned each for itself. An empty benchmark hits nothing.
Results carry the document's own columns in the struct `row`, so they can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of benchmark text in one automaton (about 250 MB); below the 1,112,062 letters that its alphabet has.
MOST_WORDS = 1_000_000
#: Bytes to lower case, and all ASCII but letters and digits to space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 97 or 122 < b < 128 else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The letter of words that no benchmark item has; words of items take the letters after it.
_OTHER = "\x01"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Windows:
    """An automaton over the windows of benchmark items [(item_id, text)]."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.owners: list[list] = []
        at: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for item_id, text in items:
            line = "".join(self._letter(w) for w in words_of(text))
            for low in range(max(1, len(line) - window + 1) if line else 0):
                key = line[low : low + window]
                if key not in at:
                    at[key] = len(self.owners)
                    self.owners.append([])
                    self.automaton.add_word(key, (at[key], len(key)))
                self.owners[at[key]].append(item_id)
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            code = len(self.letters) + 2
            self.letters[word] = chr(code if code < 0xD800 else code + 0x800)
        return self.letters[word]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (first word, end word, window) of every occurrence."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), []
        get = self.letters.get
        line = "".join([get(w, _OTHER) for w in words])
        return len(words), [(end + 1 - size, end + 1, k) for end, (k, size) in self.automaton.iter(line)]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[low][0], at[high - 1][1]) for low, high in ranges]


def _parts(text: str | None, window: int, most_words: int) -> Iterator[str]:
    """The text, or parts of at most `most_words` words that together have the same windows."""
    words = words_of(text)
    if len(words) <= most_words:
        yield text or ""
        return
    step = max(1, most_words - window + 1)
    for low in range(0, max(1, len(words) - window + 1), step):
        yield b" ".join(words[low : low + step + window - 1]).decode("utf-8", "surrogatepass")


def passes(benchmark: DataFrame, window: int, most_words: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, text) with most_words words at most; fetched one after another."""
    size = F.length(F.coalesce("text", F.lit(""))) / 2 + 1  # words at the most
    parts = int((benchmark.agg(F.sum(size)).first()[0] or 0) // most_words) + 1
    made, held, count = 0, [], 0
    for k in range(parts):
        part = benchmark.select("item_id", "text")
        part = part if parts == 1 else part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        for item_id, text in part.orderBy("item_id", "text").collect():
            for piece in _parts(text, window, most_words):
                n = len(words_of(piece))
                if held and count + n > most_words:
                    yield held
                    made, held, count = made + 1, [], 0
                held.append((item_id, piece))
                count += n
    if held or not made:
        yield held


_PAIRS = "array<struct<low: int, high: int>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """row (all columns of `docs`, which needs text), n_words, hit_ranges and hit_spans (merged), hit_items."""
    out = None
    for items in passes(benchmark, window, most_words):
        before = docs.select(F.struct("*").alias("row")) if out is None else common.settle(out, "scanned")
        out = _scan_once(before, items, window)
    return out


def _scan_once(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    again = "hit_ranges" in docs.columns
    own = dict(n_words="long", hit_ranges=_PAIRS, hit_spans=_PAIRS, hit_items="array<string>")
    schema = docs.select("row", *(F.lit(None).cast(t).alias(c) for c, t in own.items())).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(held.value, window)
        pairs = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        for batch in common.slices(batches, lambda b: b.column(0).field("text")):
            n_words, ranges, places, found = [], [], [], []
            before = batch.select(["hit_ranges", "hit_items"]).to_pylist() if again else [None] * len(batch)
            for text, old in zip(batch.column(0).field("text").to_pylist(), before, strict=True):
                n, hits = windows.scan(text)
                own_ranges = [(a, b) for a, b, _ in hits] + [(x["low"], x["high"]) for x in (old["hit_ranges"] if old else [])]
                own_ranges = _merged(own_ranges)
                n_words.append(n)
                ranges.append([{"low": a, "high": b} for a, b in own_ranges])
                places.append([{"low": a, "high": b} for a, b in (spans(text, own_ranges) if own_ranges else [])])
                owners = {str(i) for k in {k for _, _, k in hits} for i in windows.owners[k] if i is not None}
                found.append(sorted(owners | set(old["hit_items"] if old else [])))
            new = [pa.array(n_words, pa.int64()), pa.array(ranges, pairs), pa.array(places, pairs), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", *own])

    return common.in_arrow(docs, work, schema)


def digests(scanned: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"])
    return scanned.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(scan(docs, common.read(spark, sf_dir, "benchmark")))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERY = ("op6_decontaminate", query, SQL)
