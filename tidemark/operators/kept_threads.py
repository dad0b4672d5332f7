"""Reply threads that are kept up to date: a batch of comments costs what it holds, not what the forest holds.

Each comment is written once, with its path within its fragment: what hangs together of the comments known when it came. A new
reply goes on from its parent's stored path; of the stored comments only the buckets of asked parents are read. A comment whose
parent is still missing begins a fragment and leaves a row in `open`. When the parent comes, nothing is rewritten: reading the
forest links fragments to the parents that have come, follows the links between fragments (a fragment's chain is as long as parents
came late, and is halved each round), and puts the paths together.

Ids are unique whole numbers. As in `community.thread_paths`, a comment without a known parent is a root, and cycles vanish with what
hangs on them, also ones that only later batches close.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import reply_parent
from ..sources import buckets as B
from ..sources.tables import settled
from .community import resolve

_NODES = "id long, frag long, path array<bigint>, bucket long"


@dataclass(frozen=True)
class Forest:
    folder: str
    buckets: int = 64

    @property
    def nodes(self) -> B.Table:
        return B.Table(f"{self.folder}/nodes", "id", self.buckets)

    @property
    def open(self) -> str:
        return f"{self.folder}/open"


def create(spark: SparkSession, forest: Forest) -> None:
    spark.createDataFrame([], _NODES).write.parquet(forest.nodes.folder, partitionBy="bucket")
    spark.createDataFrame([], "frag long, asked long").write.parquet(forest.open)


def add(spark: SparkSession, forest: Forest, comments: DataFrame) -> None:
    """Append a batch of comments(id, body)."""
    batch = comments.select(F.col("id").cast("long").alias("id"), reply_parent(F.col("body")).try_cast("long").alias("parent"))
    local, lost = resolve(batch, "id", "parent")
    # Rows in cycles of the batch, and what hangs on them, are fragments of one comment each; their links show the cycle.
    none = F.array().cast("array<bigint>")
    alone = lost.select("id", F.col("id").alias("root"), none.alias("path"))
    rows = local.select("id", "root", F.col("path").cast("array<bigint>").alias("path")).unionByName(alone)
    roots = local.where("depth = 0").unionByName(lost, allowMissingColumns=True).select(F.col("id").alias("root"), "asked")
    held = [r[0] for r in roots.where("asked is not null").select(forest.nodes.bucket(F.col("asked"))).distinct().collect()]
    parents = spark.read.schema(_NODES).parquet(forest.nodes.folder).where(F.col(B.BUCKET).isin(held)).select(F.col("id").alias("asked"), "frag", F.col("path").alias("above"))
    grafts = settled(roots.join(parents, "asked", "left"))
    base = F.when(F.col("frag").isNull(), none).otherwise(F.concat("above", F.array("root")))
    placed = rows.join(grafts.select("root", F.coalesce("frag", "root").alias("frag"), base.alias("base")), "root").select("id", "frag", F.concat("base", "path").alias("path"))
    grafts.where("frag is null and asked is not null").select(F.col("root").alias("frag"), "asked").write.mode("append").parquet(forest.open)
    placed.withColumn(B.BUCKET, forest.nodes.bucket(F.col("id"))).repartition(B.BUCKET).sortWithinPartitions(B.BUCKET, "id").write.mode("append").partitionBy(B.BUCKET).parquet(forest.nodes.folder)


def paths(spark: SparkSession, forest: Forest) -> DataFrame:
    """id, root, depth, path of the whole forest, as `community.thread_paths` gives them."""
    nodes = spark.read.schema(_NODES).parquet(forest.nodes.folder).select("id", "frag", "path")
    parents = nodes.select(F.col("id").alias("asked"), F.col("frag").alias("into"), F.col("path").alias("above"))
    links = spark.read.schema("frag long, asked long").parquet(forest.open).join(parents, "asked").select("frag", "into", F.concat("above", F.array("frag")).alias("base"))
    # A linked fragment's base leads from the root of its chain's last fragment, which is linked to nothing, to its first comment.
    found, lost = resolve(links, "frag", "into", (F.col("into"), F.col("base")), F.col("base"))
    linked = found.select("frag", "root", F.col("path").alias("base")).unionByName(lost.select("frag"), allowMissingColumns=True).withColumn("linked", F.lit(True))
    rows = nodes.join(linked, "frag", "left").where("linked is null or root is not null")
    whole = F.concat(F.coalesce("base", F.array().cast("array<bigint>")), "path")
    return rows.select("id", F.coalesce("root", "frag").alias("root"), whole.alias("path")).select("id", "root", F.size("path").cast("long").alias("depth"), "path")
