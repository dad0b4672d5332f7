"""Files as sources and sinks: state with defaults, appended rows, and the tail of a log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import salted_hash


def load_state(spark: SparkSession, path: str, schema: str, defaults: dict, fixed: dict | None = None) -> DataFrame:
    """One row of `schema` from a JSON file. What the file lacks has its default, what it sets to null is null; without a readable file all has its default.

    fixed: values that hold whatever the file says.
    """
    kinds = spark.createDataFrame([], schema).schema
    try:
        texts = spark.read.text(path, wholetext=True).where("value <> ''").limit(1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        texts = spark.createDataFrame([], "value string")
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    found = texts.select(F.json_object_keys("value").alias("keys"), parsed.alias("held")).select(F.when(F.col("held._broken").isNull(), F.col("keys")).alias("keys"), "held")
    row = spark.range(1).join(found, F.lit(True), "left")  # one row by one row at the most
    values = fixed or {}

    def value(c) -> Column:
        default = F.lit(values.get(c.name, defaults.get(c.name))).cast(c.dataType)
        told = F.coalesce(F.array_contains("keys", F.lit(c.name)), F.lit(False))
        return default if c.name in values else F.when(told, F.col(f"held.{c.name}")).otherwise(default)

    return row.select(*(value(c).alias(c.name) for c in kinds))


def save_state(state: DataFrame, path: str) -> None:
    """Replace the file's state: one row as JSON."""
    state.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append(rows: DataFrame, path: str) -> None:
    """Insert rows into a table of files; readers see all of them or none of a failed write's."""
    rows.write.mode("append").parquet(path)


def log_audit(rows: DataFrame, path: str, pepper: str) -> bool:
    """Append audit rows (actor_type, actor_id, endpoint, method, status, ip, user_agent, latency_ms) with the address hashed.

    Whether it worked: a failure never reaches who is being audited. An empty address is none.
    """
    address = F.when(F.coalesce("ip", F.lit("")) != "", salted_hash(F.col("ip"), pepper))
    try:
        append(rows.withColumn("ip", address), path)
    except Exception:
        return False
    return True


def log_tail(lines: DataFrame, cursor: int | None, limit: int, most_bytes: int) -> DataFrame:
    """seq, line, cut of the newest lines after the cursor: `limit` at most, and `most_bytes` bytes at most.

    lines(seq, line); cut: whether older lines after the cursor were left out. The next cursor is the largest seq. The window runs
    over `limit` rows.
    """
    after = lines if cursor is None else lines.where(F.col("seq") > cursor)
    newest = after.orderBy(F.desc("seq")).limit(limit + 1)
    down = Window.orderBy(F.desc("seq"))
    sized = newest.withColumns({"place": F.row_number().over(down), "bytes": F.sum(F.octet_length("line") + 1).over(down)})
    fits = (F.col("place") <= limit) & (F.col("bytes") <= most_bytes)
    whole = Window.partitionBy(F.lit(0))
    return sized.withColumn("fits", fits).withColumn("cut", F.max(~F.col("fits")).over(whole)).where("fits").select("seq", "line", "cut")
