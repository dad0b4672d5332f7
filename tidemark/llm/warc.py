"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record, read back by offset.

`write` gives each task one archive after another, each a single gzip stream. `normalise` inflates such a stream once,
front to back, rewrites every record as its own member and writes an offset index beside it (a line of JSON per record).
`read` seeks to each record by that index. Records with equal payloads of at least `least` bytes are revisits of the one with
the smallest page_id.

Null html is an empty payload, null url an empty target. A null page_id is never the response that others revisit, but
revisits one. Pages that share a page_id and a payload are each written; which of them is the response is settled by
their url, and equal rows are all responses. An empty table makes no archive, and reading none gives no rows. Other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
#: Uncompressed bytes after which a task starts a new archive.
FILE_BYTES = 64 << 20
#: Of compression: the archives stand beside each other and the shuffled pages until the job ends.
LEVEL = 6
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no block; Payload-Length tells the length of the full payload."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + payload + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, raw record) of an inflated stream."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = parse_head(bytes(held[:end]))
                need = end + 4 + int(head["Content-Length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file, member after member, in pieces."""
    engine = zlib.decompressobj(31)
    while raw := stream.read(size):
        while raw:
            yield engine.decompress(raw)
            raw = engine.unused_data if engine.eof else b""
            if engine.eof:
                engine = zlib.decompressobj(31)


def with_origin(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_digest and refers_to (the page_id that a page revisits, or null)."""
    html = F.coalesce("html", F.lit(""))
    told = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("size"), F.xxhash64(F.coalesce("url", F.lit(""))).alias("tie"))
    ids = told.drop("html", "url")
    many = ids.where(F.col("size") >= least).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tie"))).alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null").drop("n")
    # Only ids and digests meet here; a digest that many pages share is an inner join that Spark can split.
    revisits = ids.join(many, "payload_digest").where(~F.struct("page_id", "tie").eqNullSafe(F.col("origin")))
    revisits = revisits.groupBy("page_id", "tie", "payload_digest").agg(F.first("origin.page_id").alias("refers_to"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "tie", "payload_digest")]
    return told.alias("a").join(revisits.alias("b"), same[0] & same[1] & same[2], "left").select("a.page_id", "a.url", "a.html", "a.payload_digest", "b.refers_to")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write with_origin rows as archives of one gzip stream each. Returns file, n_records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, parts, size, count = TaskContext.get(), [], [], 0, 0
        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

        def close() -> None:
            name = f"pages-{task.partitionId():06d}-{len(made):06d}.warc.gz"
            made.append((common.write_file(folder, name, [*parts, engine.flush()], task.taskAttemptId()), count))

        for batch in common.slices(batches, "html"):
            for row in batch.to_pylist():
                raw = record(row["page_id"], row["url"] or "", (row["html"] or "").encode("utf-8", "surrogatepass"), row["payload_digest"], row["refers_to"])
                parts.append(engine.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    close()
                    engine, parts, size, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, 0
        if count:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in made], pa.string()), "n_records": pa.array([x[1] for x in made], pa.int64())})

    return common.settle(common.in_arrow(pages, work, "file string, n_records long"), "warc-files")


_INDEX = "file string, offset long, length long, record_id string, uri string"


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record, and `<archive>.idx` beside it. Returns the index rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for batch in batches:
            for source in batch.column("file").to_pylist():
                name, offset, parts, rows = source.rsplit("/", 1)[1], 0, [], []
                fs, path = common.file_system(source)
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, raw in records(inflate(stream)):
                        parts.append(gzip.compress(raw, LEVEL, mtime=0))
                        rows.append({"file": f"{folder}/{name}", "offset": offset, "length": len(parts[-1]), "record_id": head["WARC-Record-ID"], "uri": head["WARC-Target-URI"]})
                        offset += len(parts[-1])
                common.write_file(folder, name, parts, task.taskAttemptId())
                common.write_file(folder, f"{name}.idx", ["".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode("utf-8", "surrogatepass")], task.taskAttemptId())
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("uri", pa.string())]))

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return common.settle(common.in_arrow(files.select("file").repartition(tasks, "file"), work, _INDEX), "warc-index")


_READ = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records behind index rows; the digests of payloads that are there are checked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, object] = {}
        for batch in batches:
            rows = []
            for at in batch.to_pylist():
                if at["file"] not in opened:
                    for f in opened.values():
                        f.close()
                    fs, path = common.file_system(at["file"])
                    opened = {at["file"]: fs.open_input_file(path)}
                opened[at["file"]].seek(at["offset"])
                raw = zlib.decompress(opened[at["file"]].read(at["length"]), 31)
                end = raw.index(b"\r\n\r\n")
                head = parse_head(raw[:end])
                payload = raw[end + 4 : -4]
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"wrong payload digest in {at['file']} at {at['offset']}")
                page_id, refers = head.get("Page-ID"), head.get("Refers-To-Page-ID")
                rows.append({
                    "page_id": None if page_id is None else int(page_id), "uri": head["WARC-Target-URI"], "payload_bytes": int(head["Payload-Length"]), "payload_digest": digest,
                    "record_type": head["WARC-Type"], "refers_to": None if refers is None else int(refers), "payload": payload if with_payload else None,
                })
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return common.in_arrow(index.select("file", "offset", "length"), work, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_origin(common.read(spark, sf_dir, "pages"))
    files = write(pages, common.shared_folder(spark, "warc-whole"))
    index = normalise(files, common.shared_folder(spark, "warc"))
    return read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERY = ("op7_warc", query, SQL)
