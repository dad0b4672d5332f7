"""Token-id files: frequency-ranked ids in byte-aligned variable-length code.

A file holds the ids of documents in ascending doc_id order. Its ids are ranked by how often they occur in it, so frequent
ids get small ranks. A rank takes one to four bytes; the number of bytes of four ranks at a time stands in a control byte,
and all control bytes lie apart from the data. numpy decodes a file whole with a 256-row table of byte counts.

Layout, little-endian: magic, number of documents, ids, distinct ids and data bytes (uint64 each), doc_ids (int64), 1 for
each doc_id that isn't null (uint8), ids per document (uint32), ids by rank (uint32), control bytes, data bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder as open_encoder

MAGIC = b"TMIDS001"
END_ID = 2
#: A file is closed at this many ids (about 6 MB coded).
FILE_IDS = 4_000_000
#: Byte counts of the four ranks of each control byte.
COUNTS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids by rank, control bytes, data bytes) of an array of ids; equally frequent ids rank by value."""
    times = np.bincount(ids, minlength=1)
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank_of = np.zeros(len(times), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids]
    size = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        size += ranks >= (1 << bits)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    data[at] = ranks & 255
    for k in (1, 2, 3):
        wide = np.flatnonzero(size > k)
        data[at[wide] + k] = ranks[wide] >> np.uint32(8 * k) & 255
    return order.astype("<u4"), control, data


def unpack(by_rank: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = COUNTS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(size > k)
        if not len(wide):
            break
        ranks[wide] |= data[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return by_rank[ranks].astype("<u4")


def to_bytes(doc_ids: list[int | None], ids: list[bytes]) -> list[bytes]:
    by_rank, control, data = pack(np.frombuffer(b"".join(ids), "<u4"))
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    head = np.array([len(ids), lengths.sum(dtype=np.uint64), len(by_rank), len(data)], "<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return [MAGIC, head.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), lengths.tobytes(), by_rank.tobytes(), control.tobytes(), data.tobytes()]


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, distinct, size = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    parts = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", distinct), ("u1", -(-n // 4)), ("u1", size)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    doc_ids = [int(x) if known else None for x, known in zip(parts[0], parts[1], strict=True)]
    return doc_ids, parts[2], unpack(parts[3], parts[4], parts[5], n)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every text of docs(doc_id, text) to files in `folder`, in ascending doc_id order.

    Returns one row per file: file, part, number (files sort by part, then number), n_docs, n_tokens. Null text is empty;
    null doc_ids come first; rows that share a doc_id are ordered by a hash of their text. An empty table writes nothing.
    """
    rows = docs.select("doc_id", "text", common.row_tie(F.col("text")).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = open_encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, ids, held, made = [], [], 0, []

        def close() -> None:
            name = f"ids-{task.partitionId():06d}-{len(made):06d}.bin"
            made.append((common.write_file(folder, name, to_bytes(doc_ids, ids), task.taskAttemptId()), task.partitionId(), len(made), len(ids), held))

        for batch in common.slices(batches, "text", common.ENCODED):
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= file_ids:
                    close()
                    doc_ids, ids, held = [], [], 0
        if ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "part", "number", "n_docs", "n_tokens"])

    return common.settle(common.in_arrow(rows, work, "file string, part int, number int, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read files back: doc_id, start, n_tokens, ids_crc32, and with `with_ids` the ids as binary."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    # One row per partition of the writing job, not per document.
    before = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.join(parts, "part").select("file", (F.col("part_start") + F.coalesce(within, F.lit(0))).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = from_bytes(common.read_file(file))
                ends = np.cumsum(lengths, dtype=np.int64)
                view, lows = memoryview(ids.tobytes()), ends - lengths
                own = [view[4 * a : 4 * b] for a, b in zip(lows.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(lows + start), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.tobytes() for x in own], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.in_arrow(placed.repartition(common.tasks(files), "file"), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark, "ids")
    files = write(common.read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(files)


QUERY = ("op1_token_files", query, None)
