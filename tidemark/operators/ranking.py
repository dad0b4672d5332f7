"""Ranks from kept counts: ledger batches move actors between counts, and one actor's rank reads one block of each level.

Three tables in place (sources.buckets): `actors` (actor, points) in blocks of ids; `values` (points, block, n): how many actors of an
id block have these points, in blocks of points; `totals` (points block, n). A rank is 1 + the actors in higher blocks of points, those of
higher points in one's own block, those of one's points in earlier id blocks, and those before one in one's own id block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import buckets as B
from ..sources.tables import settled


@dataclass(frozen=True)
class Ranks:
    """Where the kept tables lie; ids: actors of a block, points: values of a block."""

    folder: str
    ids: int = 65_536
    points: int = 1_024

    @property
    def actors(self) -> B.Table:
        return B.Table(f"{self.folder}/actors", "actor", width=self.ids)

    @property
    def values(self) -> B.Table:
        return B.Table(f"{self.folder}/values", "points", width=self.points)

    @property
    def totals(self) -> B.Table:
        return B.Table(f"{self.folder}/totals", "level", buckets=1)

    def block(self, actor: Column) -> Column:
        return F.floor(actor / self.ids).cast("long")

    def level(self, points: Column) -> Column:
        return F.floor(points / self.points).cast("long")


def create(spark: SparkSession, ranks: Ranks) -> None:
    """Empty tables: each has one row that counts for nothing, as a bucket never loses all rows."""
    B.create(ranks.actors, spark.createDataFrame([(None, 0)], "actor long, points long"))
    B.create(ranks.values, spark.createDataFrame([(0, 0, 0)], "points long, block long, n long"))
    B.create(ranks.totals, spark.createDataFrame([(0, 0)], "level long, n long"))


def apply(spark: SparkSession, ranks: Ranks, ledger: DataFrame) -> None:
    """Add a batch of ledger rows (actor, delta); rows with a null actor count for nobody. Only the blocks that it touches are read and written."""
    moves = ledger.where(F.col("actor").isNotNull()).groupBy(F.col("actor").cast("long").alias("actor")).agg(F.sum("delta").cast("long").alias("delta"))
    blocks = [r[0] for r in moves.select(ranks.block(F.col("actor"))).distinct().collect()]
    before = spark.read.parquet(ranks.actors.folder).where(F.col(B.BUCKET).isin(blocks)).select("actor", F.col("points").alias("before"))
    moves = settled(moves.join(before, "actor", "left").withColumn("points", F.coalesce("before", F.lit(0)) + F.col("delta")))
    place = ranks.block(F.col("actor")).alias("block")
    left = moves.where("before is not null").select(F.col("before").alias("points"), place, F.lit(-1).cast("long").alias("n"))
    came = moves.select("points", place, F.lit(1).cast("long").alias("n"))
    shifts = settled(left.unionByName(came).groupBy("points", "block").agg(F.sum("n").alias("n")).where("n <> 0"))
    B.upsert(spark, ranks.actors, moves.select("actor", "points"))
    B.change(spark, ranks.values, shifts, lambda rows: rows.unionByName(shifts).groupBy("points", "block").agg(F.sum("n").alias("n")))
    B.add_to(spark, ranks.totals, shifts.select(ranks.level(F.col("points")).alias("level"), "n"), "n")


def rank(spark: SparkSession, ranks: Ranks, actor: int) -> tuple[int, int]:
    """(points, rank) of one actor; without a ledger row 0 points. Reads one block of ids, one of points, and the totals."""
    own = spark.read.parquet(ranks.actors.folder).where(F.col(B.BUCKET) == actor // ranks.ids)
    points = own.where(F.col("actor") == actor).agg(F.coalesce(F.max("points"), F.lit(0))).first()[0]
    level, block = points // ranks.points, actor // ranks.ids
    within = own.where((F.col("points") == points) & (F.col("actor") < actor)).count()
    higher = (F.col("points") > points) | ((F.col("points") == points) & (F.col("block") < block))
    values = spark.read.parquet(ranks.values.folder).where((F.col(B.BUCKET) == level) & higher).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = spark.read.parquet(ranks.totals.folder).where(F.col("level") > level).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return points, 1 + totals + values + within


def all_ranks(spark: SparkSession, ranks: Ranks) -> DataFrame:
    """actor, points, rank of every actor that has a ledger row, from the kept counts; sorted block by block."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = B.read(spark, ranks.totals).withColumn("above", F.coalesce(F.sum("n").over(before(Window.orderBy(F.desc("level")))), none))  # a row a block of points
    values = B.read(spark, ranks.values).withColumn("level", ranks.level(F.col("points")))
    earlier = F.coalesce(F.sum("n").over(before(Window.partitionBy("level").orderBy(F.desc("points"), "block"))), none)
    start = values.withColumn("earlier", earlier).join(totals.select("level", "above"), "level").select("points", "block", (F.col("above") + F.col("earlier")).alias("start"))
    rows = B.read(spark, ranks.actors).where("actor is not null").withColumn("block", ranks.block(F.col("actor")))
    place = F.row_number().over(Window.partitionBy("points", "block").orderBy("actor"))
    return rows.withColumn("place", place).join(start, ["points", "block"]).select("actor", "points", (F.col("start") + F.col("place")).alias("rank"))


def groups_above(spark: SparkSession, ranks: Ranks, points: int) -> int:
    """How many actors have more points: the totals of higher blocks and one block of values."""
    level = points // ranks.points
    values = spark.read.parquet(ranks.values.folder).where((F.col(B.BUCKET) == level) & (F.col("points") > points)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return values + spark.read.parquet(ranks.totals.folder).where(F.col("level") > level).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
