"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a single-machine session without spark.checkpoint.dir keeps its shared files.
LOCAL_SHARED = "/tmp/checkpoints"
#: Bytes of text that are encoded at once.
ENCODED = 5 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    with contextlib.suppress(Exception):
        fs, path = file_system(folder)
        fs.delete_dir(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again: lineage is cut, and lost executors lose nothing."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri[5:]}")


def write_file(folder: str, name: str, parts: list[bytes], attempt: int) -> str:
    """Write a file under another name and move it into place, so that a repeated task leaves whole files only."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{attempt}.{os.getpid()}"
    with fs.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
    final = f"{path}/{name}"
    try:
        fs.move(draft, final)
    except OSError:
        fs.delete_file(final)
        fs.move(draft, final)
    return f"{folder}/{name}"


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after another, and where each text starts (one more entry than texts)."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str | Callable, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` (a name, or a function of the batch) each, so that long texts
    don't pile up."""
    for batch in batches:
        size = (column(batch) if callable(column) else batch.column(batch.schema.get_field_index(column))).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, after which a worker that waits for its next task gives its free memory back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # C libraries other than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: others, whatever their names, are left behind."""
    return df.select(*columns)


def row_tie(text: Column) -> Column:
    """A second sort key that makes the order of rows with the same id settled."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes: a table look-up for each half byte, the lower one first."""
    steps = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ 0xEDB88320 if k & 1 else k >> 1
        steps.append(k)
    digit = f"instr('123456789ABCDEF', hex(encode({text}))[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END])"
    halves = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1), lambda i: {digit}::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {halves}), lambda c, h: xor(c >> 4, ({steps}::BIGINT[])[(xor(c, h) & 15) + 1])), 4294967295)"


class WordHashes:
    """64-bit hashes of words, each computed once; up to `keep` words are kept."""

    def __init__(self, keep: int = 150_000) -> None:
        from xxhash import xxh3_64_intdigest

        self.digest, self.known, self.keep = xxh3_64_intdigest, {}, keep

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.digest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
