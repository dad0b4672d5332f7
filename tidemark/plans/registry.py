"""Where the query modules put their queries, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A query, and the DuckDB SQL that gives the same rows (None where SQL can't).
Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]
FOUND: dict[str, Entry] = {}

AS_OF = "2024-01-17 12:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"
POSTS = "SELECT o_orderkey AS id, o_orderpriority AS board, o_custkey AS actor, o_orderdate AS created, o_orderstatus AS status FROM orders"
COUNTED = f"""SELECT p.*, CAST(coalesce(up, 0) AS BIGINT) AS up, CAST(coalesce(down, 0) AS BIGINT) AS down, CAST(coalesce(comments, 0) AS BIGINT) AS comments
FROM ({POSTS}) p LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS up, count(*) FILTER (l_returnflag = 'R') AS down, count(*) AS comments FROM lineitem GROUP BY 1) l ON l_orderkey = id"""
LEDGER = "SELECT event_id, user_id AS actor, ts, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS delta FROM events WHERE event_type IN ('view', 'error')"


def bucket(unit: str, ts: str) -> str:
    return f"(date_trunc('{unit}', {ts} + INTERVAL 9 HOUR) - INTERVAL 9 HOUR)"


def query(name: str, sql: str | None):
    def add(f):
        FOUND[name] = (f, sql)
        return f

    return add


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")
