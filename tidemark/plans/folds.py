"""Queries on per-key rules: windows from the first event, locks, reservations, challenges, quotas and streaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import community as C
from ..operators import folds as R
from ..sources.tables import table
from .registry import NOW, now, query

_ORDERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "props")


@query("t02_network_limit", """SELECT hour, count(*) AS n, count(*) FILTER (place <= 10) AS admitted FROM (SELECT date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY ts, event_id) AS place FROM events) GROUP BY 1""")
def _(spark, d):
    # Whole hours are the same at UTC and at UTC+9.
    rows = C.calendar_limit(_events(spark, d), ["event_type"], S.bucket_start("hour", F.col("ts")), ["ts", "event_id"], 10)
    return rows.groupBy(F.col("bucket").alias("hour")).agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


@query("t03_window_limit", """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 DAY) FROM a WHERE a.ts IS NOT NULL),
w AS (SELECT a.user_id, a.ts, count(*) AS n FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts AND e.ts < a.ts + INTERVAL 1 DAY GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(least(n, 2)) AS BIGINT) AS admitted FROM w GROUP BY 1""")
def _(spark, d):
    rows = R.fold(_events(spark, d), "user_id", ["ts", "event_id"], ["ts"], R.window_limit(2, 86_400))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


@query("t06_bucket_cooldown", "SELECT user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = _events(spark, d).select("user_id", S.epoch_bucket(F.col("ts"), 3600).alias("bucket"), "event_id")
    return C.keep_first(rows, ["user_id", "bucket"], ["event_id"])


@query("t07_failure_lock", f"""WITH RECURSIVE {_ORDERED},
f AS (SELECT user_id, k, event_type <> 'purchase' AS failed, ts, CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END AS fails, CAST(NULL AS TIMESTAMP) AS until, CASE WHEN event_type <> 'purchase' THEN 'failed' ELSE 'ok' END AS outcome FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_type <> 'purchase', e.ts,
  CASE WHEN f.until > e.ts THEN f.fails WHEN e.event_type = 'purchase' THEN 0 ELSE f.fails + 1 END,
  CASE WHEN f.until > e.ts THEN f.until WHEN e.event_type = 'purchase' THEN NULL WHEN f.fails + 1 >= 3 THEN e.ts + INTERVAL 1 DAY ELSE f.until END,
  CASE WHEN f.until > e.ts THEN 'locked' WHEN e.event_type = 'purchase' THEN 'ok' WHEN f.fails + 1 >= 3 THEN 'locking' ELSE 'failed' END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, outcome, count(*) AS n FROM f GROUP BY 1, 2""")
def _(spark, d):
    rows = _events(spark, d).withColumn("failed", F.col("event_type") != "purchase")
    return R.fold(rows, "user_id", ["ts", "event_id"], ["ts", "failed"], R.failure_lock(3, 86_400)).groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


@query("t10_heartbeat", """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY user_id
UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.event_type = 'view' AND e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 10 MINUTE) FROM a WHERE a.ts IS NOT NULL)
SELECT user_id, count(ts) AS accepted FROM a WHERE ts IS NOT NULL GROUP BY user_id""")
def _(spark, d):
    rows = R.fold(_events(spark, d).where("event_type = 'view'"), "user_id", ["ts", "event_id"], ["ts"], R.cooldown(600))
    return rows.where("admitted").groupBy("user_id").agg(F.count("*").alias("accepted"))


@query("t11_reservation", f"""WITH RECURSIVE {_ORDERED},
f AS (SELECT user_id, k, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS accounts, CASE WHEN event_type = 'purchase' THEN ts ELSE ts + INTERVAL 12 HOUR END AS until, CASE WHEN event_type = 'purchase' THEN 'bound' ELSE 'reserved' END AS outcome FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, CASE WHEN e.event_type = 'purchase' THEN f.accounts + 1 ELSE f.accounts END,
  CASE WHEN e.event_type = 'purchase' THEN e.ts WHEN f.accounts >= 5 OR f.until > e.ts THEN f.until ELSE e.ts + INTERVAL 12 HOUR END,
  CASE WHEN e.event_type = 'purchase' THEN 'bound' WHEN f.accounts >= 5 THEN 'limit' WHEN f.until > e.ts THEN 'held' ELSE 'reserved' END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, outcome, count(*) AS n FROM f GROUP BY 1, 2""")
def _(spark, d):
    rows = _events(spark, d).withColumn("binds", F.col("event_type") == "purchase")
    return R.fold(rows, "user_id", ["ts", "event_id"], ["ts", "binds"], R.reservation(5, 43_200)).groupBy("user_id", "outcome").agg(F.count("*").alias("n"))


# Challenges: each user's events of an hour try to answer one that ends after 40 minutes; k = 7 * j answers it.
@query("t12_challenge", """WITH e AS (SELECT *, date_trunc('hour', ts) AS challenge, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
o AS (SELECT *, sum(CASE WHEN ts < challenge + INTERVAL 40 MINUTE AND k % 7 <> 0 THEN 1 ELSE 0 END) OVER w AS wrong, max(CASE WHEN ts >= challenge + INTERVAL 40 MINUTE THEN 1 ELSE 0 END) OVER w AS ended FROM e WINDOW w AS (PARTITION BY challenge ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, max(CASE WHEN ts < challenge + INTERVAL 40 MINUTE AND k % 7 = 0 AND coalesce(wrong, 0) < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY challenge ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solved FROM o)
SELECT CASE WHEN solved = 1 OR ended = 1 THEN 'not_found' WHEN ts >= challenge + INTERVAL 40 MINUTE THEN 'expired' WHEN coalesce(wrong, 0) >= 3 THEN 'locked' WHEN k % 7 <> 0 THEN 'invalid' ELSE 'ok' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def _(spark, d):
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = _events(spark, d).select("event_id", "ts", at.alias("challenge"), (at + F.expr("INTERVAL 40 MINUTES")).alias("ends"), (F.get_json_object("props", "$.k").cast("long") % 7).cast("string").alias("given"), F.lit("0").alias("answer"))
    return R.fold(rows, "challenge", ["ts", "event_id"], ["ts", "ends", "given", "answer"], R.challenge(3)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("w08_latest_code", "SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2")
def _(spark, d):
    return _events(spark, d).where("event_id % 3 <> 0").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("t13_code_check", f"""WITH c AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT q.user_id, CASE WHEN ts IS NULL THEN 'not_found' WHEN ts + INTERVAL 10 DAY <= {NOW} THEN 'expired' WHEN k >= 90 THEN 'locked' WHEN k % 2 = 1 THEN 'invalid' ELSE 'ok' END AS outcome
FROM (SELECT DISTINCT user_id FROM events) q LEFT JOIN (SELECT c.user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM c JOIN events USING (event_id)) x ON x.user_id = q.user_id""")
def _(spark, d):
    users = _events(spark, d).select("user_id").distinct()
    codes = _events(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.max_by(F.struct("ts", F.get_json_object("props", "$.k").cast("long").alias("k")), "event_id").alias("c"))
    at, k = F.col("c.ts"), F.col("c.k")
    outcome = F.when(at.isNull(), "not_found").when(at + F.expr("INTERVAL 10 DAYS") <= now(), "expired").when(k >= 90, "locked").when(k % 2 == 1, "invalid").otherwise("ok")
    return users.join(codes, "user_id", "left").select("user_id", outcome.alias("outcome"))


@query("t14_cache_valid", f"SELECT event_id, ts + INTERVAL 10 MINUTE > {NOW} AS valid FROM events WHERE ts <= {NOW}")
def _(spark, d):
    return _events(spark, d).where(F.col("ts") <= now()).select("event_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES") > now()).alias("valid"))


@query("t15_daily_quota", "SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS clicks, greatest(0, 3 - count(*)) AS unused FROM events GROUP BY 1, 2")
def _(spark, d):
    grouped = _events(spark, d).groupBy("user_id", S.local_date(F.col("ts")).alias("day"))
    return grouped.agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.greatest(F.lit(0), 3 - F.count("*")).cast("long").alias("unused"))


@query("t16_failure_streak", """WITH r AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, run, count(*) FILTER (event_type = 'error') AS n FROM r GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, max(n) >= 3 AS stopped FROM s GROUP BY 1""")
def _(spark, d):
    run = F.sum(F.when(F.col("event_type") == "error", 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    streaks = _events(spark, d).withColumn("run", run).groupBy("user_id", "run").agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return streaks.groupBy("user_id").agg(F.max("n").alias("longest"), (F.max("n") >= 3).alias("stopped"))


@query("t18_growing_text", """SELECT conv_id, max(n) AS shown FROM (SELECT conv_id, length(text) AS n FROM conversations) GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    shown = R.fold(rows, "conv_id", ["turn"], ["text"], R.growing_text())
    return shown.groupBy("conv_id").agg(F.max_by(F.length("shown"), "turn").cast("long").alias("shown"))
