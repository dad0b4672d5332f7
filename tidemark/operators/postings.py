"""Inverted indexes as tables: from a term to the ids of the rows that have it.

A posting row holds a term's sorted ids of one block of ids, as distances from the block's start, which the file format
codes as differences; so however common a term is, no row holds more than `block` ids. Rows are laid out in partitions by
the term's CRC-32 and sorted by term within files: a search reads only the partitions and row groups of the terms that it asks for.

A search counts its terms' postings, then intersects the lists block by block, rarest term first; blocks that lack a term go
before any list is read out. A row lives in one batch: a changed row is added in a later one, and `voids` tells up to which
batch a row's older postings no longer hold. Ids are whole numbers; rows with a null id aren't indexed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of candidate blocks up to which a search for texts asks for their partitions by name.
MOST_BLOCKS = 10_000
#: Blocks of one partition of terms that a task writes together.
SPREAD = 256
#: Trigrams of texts that a task gathers into lists at once (some 100 MB), and lists that it sends at once.
HELD, LISTED = 4_000_000, 20_000


@dataclass(frozen=True)
class Index:
    folder: str
    buckets: int = 64
    block: int = 65_536


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and _."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)")))


@dataclass(frozen=True)
class Trigrams:
    """The terms of `trigrams(text)`, which tasks list without a row for each."""

    text: Column


def trigrams(text: Column) -> Trigrams:
    """Distinct runs of three characters of the lower-case text."""
    return Trigrams(text)


def _trigram_lists(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (id, text) to rows (term, block, ids): the sorted ids, from the block's start on, of each `HELD` characters of text."""

    def lists(codes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        own = ids // block
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])))
        heads, edges, at = codes[first], np.append(first, len(codes)), (ids - own * block).astype(np.int32)
        units = np.stack([heads >> 42, heads >> 21 & 0x1FFFFF, heads & 0x1FFFFF], 1).astype("<u4")
        for low in range(0, len(first), LISTED):
            high = min(low + LISTED, len(first))
            terms = units[low:high].tobytes().decode("utf-32-le", "surrogatepass")
            told = pa.ListArray.from_arrays(pa.array((edges[low : high + 1] - edges[low]).astype(np.int32)), pa.array(at[edges[low] : edges[high]]))
            yield pa.RecordBatch.from_arrays([pa.array([terms[k : k + 3] for k in range(0, len(terms), 3)], pa.string()), pa.array(own[first[low:high]]), told], names=["term", "block", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, held = [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                units = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                own = np.unique(units[:-2] << 42 | units[1:-1] << 21 | units[2:]) if len(units) > 2 else units[:0]
                codes.append(own)
                ids.append(np.full(len(own), id_, np.int64))
                held += len(own)
                if held >= HELD:
                    yield from lists(np.concatenate(codes), np.concatenate(ids))
                    codes, ids, held = [], [], 0
        if held:
            yield from lists(np.concatenate(codes), np.concatenate(ids))

    return work


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_POSTINGS = "term string, block long, batch long, n int, ids array<int>, bucket int"


def add(index: Index, rows: DataFrame, id_: str, terms: Column | Trigrams, replaces: bool = False) -> int:
    """Index rows under their terms (an array, or trigrams); gives the batch's number. replaces: earlier versions of the same ids no longer hold."""
    spark = rows.sparkSession
    batch = 1 + (_read(spark, f"{index.folder}/batches", "batch long").agg(F.max("batch")).first()[0] or 0)
    own = rows.where(F.col(id_).isNotNull())
    block = F.floor(F.col("id") / index.block)
    if isinstance(terms, Trigrams):
        parts = own.select(F.col(id_).cast("long").alias("id"), F.lower(F.coalesce(terms.text, F.lit(""))).alias("text")).mapInArrow(_trigram_lists(index.block), "term string, block long, ids array<int>")
        # A task has sent a term once for each block and some megabytes of text.
        lists = parts.groupBy("term", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    else:
        flat = own.select(F.col(id_).cast("long").alias("id"), F.explode(terms).alias("term"))
        lists = flat.groupBy("term", block.alias("block")).agg(F.array_sort(F.collect_set((F.col("id") - block * index.block).cast("int"))).alias("ids"))
    if replaces:
        own.select(F.col(id_).cast("long").alias("id"), F.lit(batch - 1).cast("long").alias("upto")).distinct().write.mode("append").parquet(f"{index.folder}/voids")
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(index.buckets)).cast("int")
    laid = lists.select("term", "block", F.lit(batch).cast("long").alias("batch"), F.size("ids").alias("n"), "ids", bucket.alias("bucket"))
    dealt = laid.repartition("bucket", F.floor(F.col("block") / SPREAD)).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("append").partitionBy("bucket").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#ids.list.element", "false").parquet(f"{index.folder}/postings")
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{index.folder}/batches")
    return batch


def asked(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """The posting rows of these terms: of their partitions only."""
    buckets = sorted({crc32(t.encode()) % index.buckets for t in terms})
    return _read(spark, f"{index.folder}/postings", _POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))


def counts(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """term, n: how many rows each term has, from the postings' own counts (voided versions included)."""
    return asked(spark, index, terms).groupBy("term").agg(F.sum("n").alias("n"))


def search(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """id of the rows that have all terms; none for no terms."""
    terms, none = sorted(set(terms)), spark.createDataFrame([], "id long")
    sizes = dict(map(tuple, counts(spark, index, terms).collect())) if terms else {}
    if not terms or len(sizes) < len(terms):
        return none
    rarest = sorted(terms, key=lambda t: (sizes[t], t))
    whole = asked(spark, index, terms).groupBy("block", "batch").agg(F.count("*").alias("found"), F.map_from_entries(F.collect_list(F.struct("term", "ids"))).alias("lists")).where(F.col("found") == len(terms))
    ids = F.col("lists")[rarest[0]]
    for term in rarest[1:]:
        ids = F.array_intersect(ids, F.col("lists")[term])
    found = whole.select("batch", "block", F.explode(ids).alias("at")).select("batch", (F.col("block") * index.block + F.col("at")).alias("id"))
    voids = _read(spark, f"{index.folder}/voids", "id long, upto long").groupBy("id").agg(F.max("upto").alias("upto"))
    return found.join(voids, "id", "left").where("upto is null or batch > upto").select("id")


def fixed_parts(pattern: str, escape: str = "\\") -> list[str]:
    """The runs of a LIKE pattern between its wildcards % and _, in lower case."""
    runs = [""]
    for part in re.findall(rf"{re.escape(escape)}.|.", pattern, re.DOTALL):
        if part in "%_":
            runs.append("")
        else:
            runs[-1] += part[-1]
    return [r.lower() for r in runs if r]


def pattern_trigrams(pattern: str) -> list[str]:
    """What every text that matches the pattern has; empty if no run of three characters is fixed."""
    return sorted({run[k : k + 3] for run in fixed_parts(pattern) for k in range(len(run) - 2)})


def lay_out(rows: DataFrame, id_: str, folder: str, block: int) -> None:
    """Write rows in partitions by blocks of ids, so that candidates' rows can be read without the others."""
    placed = rows.withColumn("block", F.floor(F.col(id_) / block))
    placed.repartition("block").write.partitionBy("block").parquet(folder)


def of_ids(spark: SparkSession, folder: str, id_: str, ids: DataFrame, block: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows of a laid-out table whose id is among ids(id): only the blocks that hold one are read."""
    rows = spark.read.parquet(folder)
    blocks = [r[0] for r in ids.select(F.floor(F.col("id") / block).alias("block")).distinct().limit(most_blocks + 1).collect()]
    rows = rows.where(F.col("block").isin(blocks)) if len(blocks) <= most_blocks else rows
    return rows.join(ids.select(F.col("id").alias("_id")).distinct(), F.col(id_) == F.col("_id"), "left_semi").drop("block")


def ilike(spark: SparkSession, index: Index, folder: str, id_: str, text: str, pattern: str, block: int) -> DataFrame:
    """Rows of a laid-out table whose text matches the pattern: candidates from the trigram index, confirmed on the text.

    A pattern without three fixed characters in a row reads all rows.
    """
    terms = pattern_trigrams(pattern)
    rows = of_ids(spark, folder, id_, search(spark, index, terms), block) if terms else spark.read.parquet(folder).drop("block")
    return rows.where(F.col(text).ilike(pattern))
