"""Queries on changes: each gives the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import writes as W
from ..sources.tables import changes, posts, table
from .registry import AS_OF, NOW, POSTS, now, query


@query("m03_increment", "SELECT c_custkey AS actor, CAST(c_nationkey + coalesce(n, 0) AS BIGINT) AS points FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey UNION ALL SELECT user_id, count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def _(spark, d):
    totals = table(spark, d, "customer").select(F.col("c_custkey").alias("actor"), F.col("c_nationkey").cast("long").alias("points"))
    new = table(spark, d, "events").groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("points"))
    return W.increment(totals, new, "actor", "points")


@query("m04_bulk_update", "SELECT status, count(*) AS n, count(*) FILTER (changed) AS changed FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS changed FROM orders) GROUP BY 1")
def _(spark, d):
    rows = W.update_where(posts(spark, d), F.col("status") == "P", {"status": F.lit("O")})
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("m05_rotation", f"""SELECT id, owner, CASE WHEN owner % 5 = 0 AND revoked IS NULL THEN {NOW} ELSE revoked END AS revoked FROM (SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS revoked FROM orders)
UNION ALL SELECT c_custkey + 100000000 AS id, c_custkey AS owner, CAST(NULL AS TIMESTAMP) AS revoked FROM customer WHERE c_custkey % 5 = 0""")
def _(spark, d):
    tokens = posts(spark, d).select("id", F.col("actor").alias("owner"), F.when(F.col("status") == "F", F.col("created")).alias("revoked"))
    new = table(spark, d, "customer").where("c_custkey % 5 = 0").select((F.col("c_custkey") + 100_000_000).alias("id"), F.col("c_custkey").alias("owner"), F.lit(None).cast("timestamp_ntz").alias("revoked"))
    return W.rotate(tokens, new, "owner", "revoked", now())


@query("m06_soft_delete", f"SELECT id, CASE WHEN actor = 3 THEN 'DELETED' ELSE status END AS status, CASE WHEN actor = 3 THEN {NOW} END AS deleted FROM ({POSTS})")
def _(spark, d):
    rows = posts(spark, d).withColumn("deleted", F.lit(None).cast("timestamp_ntz"))
    return W.update_where(rows, F.col("actor") == 3, {"status": F.lit("DELETED"), "deleted": now()}).select("id", "status", "deleted")


@query("m07_confiscation", f"""WITH l AS (SELECT event_id % 500 AS target, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS delta FROM events WHERE event_type IN ('view', 'error')),
n AS (SELECT target, sum(delta) AS net FROM l GROUP BY 1)
SELECT id AS target, actor AS author, CAST(greatest(0, coalesce(net, 0)) AS BIGINT) AS taken FROM ({POSTS}) LEFT JOIN n ON n.target = id WHERE status = 'F' AND id % 3 <> 0""")
def _(spark, d):
    ledger = changes(spark, d).where("reason = 'VOTE_CHANGE'")
    own = posts(spark, d).where("status = 'F'").select(F.col("id").alias("target"), F.col("actor").alias("author"))
    return W.confiscate_once(ledger, own, own.where("target % 3 = 0"))


# Claims: parts want names; suppliers hold some already.
_CLAIMS = "SELECT p_partkey AS owner, CASE WHEN p_size % 2 = 0 THEN 'HUMAN' ELSE 'AGENT' END AS kind, p_name AS key, p_size AS since FROM part"
_HELD = "SELECT min(p_partkey) AS owner, 'HUMAN' AS kind, p_name AS key FROM part WHERE p_brand = 'Brand#1' GROUP BY p_name"


# Parts of one brand are there; the others come in by name.
@query("m09_reuse", f"""WITH h AS ({_HELD}), n AS (SELECT p_partkey AS id, CASE WHEN p_size <> 7 THEN p_name END AS key FROM part WHERE p_brand <> 'Brand#1')
SELECT id, n.key, coalesce(h.owner, CASE WHEN n.key IS NOT NULL THEN min(id) OVER (PARTITION BY n.key) ELSE id END) AS used FROM n LEFT JOIN h ON h.key = n.key""")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.col("p_name").alias("key"))
    new = rows.where("p_brand <> 'Brand#1'").select("id", F.when(F.col("p_size") != 7, F.col("key")).alias("key"))
    return W.insert_or_reuse(rows.where("p_brand = 'Brand#1'"), new, "key", "id").select("id", "key", "used")


@query("m10_claims", f"""WITH c AS ({_CLAIMS}), h AS ({_HELD})
SELECT c.owner, c.key, CASE WHEN h.owner <> c.owner THEN 'taken' WHEN h.kind <> c.kind THEN 'same_as_other' WHEN h.owner IS NOT NULL THEN 'own'
WHEN row_number() OVER (PARTITION BY c.key ORDER BY since, c.owner, c.kind) = 1 THEN 'claimed' ELSE 'lost' END AS outcome FROM c LEFT JOIN h USING (key)""")
def _(spark, d):
    part = table(spark, d, "part")
    claims = part.select(F.col("p_partkey").alias("owner"), F.when(F.col("p_size") % 2 == 0, "HUMAN").otherwise("AGENT").alias("kind"), F.col("p_name").alias("key"), F.col("p_size").alias("at"))
    held = part.where("p_brand = 'Brand#1'").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("owner")).withColumn("kind", F.lit("HUMAN"))
    return W.claim_names(claims, held).select("owner", "key", "outcome")


@query("m11_bans", f"""WITH b AS (SELECT c_custkey AS actor, 'old' AS reason, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {NOW} + (c_custkey % 3 - 1) * INTERVAL 1 DAY END AS expires FROM customer WHERE c_acctbal < 0),
a AS (SELECT c_custkey AS actor, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE '' END AS reason, {NOW} + INTERVAL 9 DAY AS expires FROM customer WHERE c_nationkey = 4)
SELECT coalesce(b.actor, a.actor) AS actor, CASE WHEN a.actor IS NOT NULL AND a.reason <> '' THEN a.reason ELSE b.reason END AS reason, CASE WHEN a.actor IS NOT NULL THEN a.expires ELSE b.expires END AS expires
FROM b FULL JOIN a ON a.actor = b.actor AND (b.expires IS NULL OR b.expires > {NOW})""")
def _(spark, d):
    c, id_ = table(spark, d, "customer"), F.col("c_custkey")
    days = F.expr(f"TIMESTAMP_NTZ '{AS_OF}' + make_dt_interval(CAST(c_custkey % 3 - 1 AS INT))")
    bans = c.where("c_acctbal < 0").select(id_.alias("actor"), F.lit("old").alias("reason"), F.when(id_ % 4 != 0, days).alias("expires"))
    asked = c.where("c_nationkey = 4").select(id_.alias("actor"), F.when(id_ % 2 == 0, "new").otherwise("").alias("reason"), (now() + F.expr("INTERVAL 9 DAYS")).alias("expires"))
    return W.extend_or_create(bans, asked, ["actor"], now())


@query("m13_fill_names", "SELECT p_partkey, CASE WHEN p_name IS NULL OR row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN 'part#' || p_partkey ELSE p_name END AS p_name FROM (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name END AS p_name FROM part)")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("p_name"))
    return W.fill_names(rows, "p_partkey", "p_name", "part#").select("p_partkey", "p_name")


@query("m14_audit", "SELECT event_id, sha256('10.0.0.' || user_id || '|pepper') AS ip, left(props, 5) AS meta FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.salted_hash(F.concat(F.lit("10.0.0."), "user_id"), "pepper").alias("ip"), F.left("props", F.lit(5)).alias("meta"))
