"""Bindings of the test tables to the roles of a discussion community, and tables written between steps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, board, actor, created, status of orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("board"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))


def counted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts with up, down and comments, from the lines of each order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_if(F.col("l_returnflag") == "N").alias("up"), F.count_if(F.col("l_returnflag") == "R").alias("down"), F.count("*").alias("comments"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("up", "down", "comments")}
    return posts(spark, sf_dir).join(lines, "id", "left").withColumns(zero)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor, ts, delta: views give a point, errors take one."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "error"))
    return e.select("event_id", F.col("user_id").alias("actor"), "ts", F.when(F.col("event_type") == "view", 1).otherwise(-1).cast("long").alias("delta"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, target, reason, delta of all ledger rows on 500 contents: votes (VOTE_CHANGE) and others, which no confiscation takes."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    delta = F.when(kind == "view", 1).when(kind == "error", -1).otherwise(5).cast("long")
    return e.select("event_id", (F.col("event_id") % 500).alias("target"), F.when(kind.isin("view", "error"), "VOTE_CHANGE").otherwise("BONUS").alias("reason"), delta.alias("delta"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body: comments of which most start with a reply marker. Some name later ones, some missing ones, some none."""
    id_ = F.col("event_id")
    parent = F.when(id_ % 7 == 0, None).when(id_ % 11 == 3, id_ + 1_000_000_000).when(id_ % 13 == 5, id_ + 1).otherwise(F.floor(id_ / 3))
    marker = F.when(parent.isNotNull(), F.concat(F.lit(">>"), parent.cast("string"), F.lit("  "))).otherwise("")
    return table(spark, sf_dir, "events").select(id_.alias("id"), F.concat(marker, F.col("event_type")).alias("body"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; what lies there goes when Python ends."""
    context = spark.sparkContext
    _need_shared(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    with contextlib.suppress(Exception):  # nothing was written, or the store is gone already
        uri = folder if "://" in folder or not folder.startswith("file:") else f"file://{folder[5:]}"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.delete_dir(path)


def _need_shared(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))


def settled(df: DataFrame) -> DataFrame:
    """`df` written to spark.checkpoint.dir and read again, which cuts its lineage. A local session without that setting gets a folder."""
    _need_shared(df.sparkSession)
    return df.checkpoint()
