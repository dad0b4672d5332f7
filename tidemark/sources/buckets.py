"""Tables that are changed in place: laid out in buckets of their key, of which only those that a change touches are written again.

A bucket is a partition folder: the key's hash modulo `buckets`, or blocks of `width` consecutive keys. A change first finds
its buckets (as many as the table has, at the most), reads these, and writes them with dynamic partition overwrite: files of other
buckets keep their names and times. What is written is settled in the shared folder before, so that a lost executor never has to
read a bucket that is being replaced, and a change that fails leaves every bucket as it was or as it is to be; doing it
again ends it, as long as it sets values and doesn't add to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settled

BUCKET = "bucket"


@dataclass(frozen=True)
class Table:
    """Where a table lies. width: consecutive whole-number keys of a bucket; 0: keys are hashed into `buckets`."""

    folder: str
    key: str
    buckets: int = 64
    width: int = 0

    def bucket(self, key: Column) -> Column:
        return F.floor(key / self.width).cast("long") if self.width else F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("long")


def create(table: Table, rows: DataFrame) -> None:
    """Write a table anew, sorted by key within its buckets."""
    _put(table, rows)


def _put(table: Table, rows: DataFrame) -> None:
    placed = rows.withColumn(BUCKET, table.bucket(F.col(table.key)))
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, table.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table.folder)


def read(spark: SparkSession, table: Table) -> DataFrame:
    return spark.read.parquet(table.folder).drop(BUCKET)


def of_keys(spark: SparkSession, table: Table, keys: list) -> DataFrame:
    """The rows of a few keys: their buckets only, and in these the row groups that may have them."""
    buckets = sorted({r[0] for r in spark.createDataFrame([(k,) for k in keys], spark.read.parquet(table.folder).select(table.key).schema).select(table.bucket(F.col(table.key))).collect()})
    return spark.read.parquet(table.folder).where(F.col(BUCKET).isin(buckets) & F.col(table.key).isin(keys)).drop(BUCKET)


def change(spark: SparkSession, table: Table, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of the keys in `touched` by make(their rows); gives the buckets. A bucket may not lose all its rows.

    make gets the rows without the bucket and may add rows whose keys are in `touched`.
    """
    buckets = sorted(r[0] for r in touched.select(table.bucket(F.col(table.key)).alias(BUCKET)).where(F.col(BUCKET).isNotNull()).distinct().collect())
    if buckets:
        rows = spark.read.parquet(table.folder).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
        _put(table, settled(make(rows)))
    return buckets


def upsert(spark: SparkSession, table: Table, changes: DataFrame) -> list[int]:
    """Put the rows of `changes` (unique keys, none null; all columns of the table) in the place of those with their key, or add them."""
    changes = settled(changes)

    def make(rows: DataFrame) -> DataFrame:
        others = rows.join(changes.select(table.key), table.key, "left_anti")
        return others.unionByName(changes.select(*rows.columns))

    return change(spark, table, changes, make)


def update_where(spark: SparkSession, table: Table, test: Column, values: dict[str, Column]) -> int:
    """Set `values` where the test holds; gives the number of rows. First only the key and what the test reads are scanned."""
    rows = spark.read.parquet(table.folder)
    counted = rows.where(test).groupBy(BUCKET).agg(F.min(table.key).alias(table.key), F.count("*").alias("n"))
    touched = settled(counted)
    mine = F.coalesce(test, F.lit(False))
    change(spark, table, touched.select(table.key), lambda own: own.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()}))
    return touched.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def add_to(spark: SparkSession, table: Table, changes: DataFrame, value: str) -> list[int]:
    """Add `value` of changes(key, value) to that of the key's row; new keys begin with theirs. Not to be repeated once it has ended."""
    changes = settled(changes.groupBy(table.key).agg(F.sum(value).alias("_change")))

    def make(rows: DataFrame) -> DataFrame:
        both = rows.join(changes, table.key, "full_outer")
        return both.withColumn(value, F.coalesce(value, F.lit(0)) + F.coalesce("_change", F.lit(0))).select(*rows.columns)

    return change(spark, table, changes, make)
