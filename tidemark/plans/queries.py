"""Ledgers, listings, search, joins, votes, limits, runs and threads on the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import community as C
from ..operators import folds as R
from ..sources.tables import changes, comments, counted_posts, ledger, posts, table
from .registry import COUNTED, LEDGER, NOW, POSTS, bucket, now, query

# Points ledger.
def _top(name: str, unit: str | None):
    where = f"WHERE ts >= {bucket(unit, NOW)}" if unit else ""

    @query(name, f"""WITH p AS (SELECT actor, CAST(sum(delta) AS BIGINT) AS points FROM ({LEDGER}) {where} GROUP BY actor)
SELECT row_number() OVER (ORDER BY points DESC, actor) AS rank, actor, points FROM p QUALIFY rank <= 10""")
    def run(spark, d):
        return C.top_points(ledger(spark, d), 10, S.bucket_start(unit, now()) if unit else None)


_top("a03_weekly_points", "week")
_top("a03_monthly_points", "month")
_top("a03_total_points", None)


@query("w02_actor_rank", f"""WITH p AS (SELECT actor, CAST(sum(delta) AS BIGINT) AS points FROM ({LEDGER}) GROUP BY actor),
q AS (SELECT DISTINCT user_id AS actor FROM events), a AS (SELECT q.actor, coalesce(points, 0) AS points FROM q LEFT JOIN p USING (actor))
SELECT a.actor, a.points, 1 + (SELECT count(*) FROM p WHERE p.points > a.points OR (p.points = a.points AND p.actor < a.actor)) AS rank FROM a""")
def _(spark, d):
    return C.rank_of(ledger(spark, d), table(spark, d, "events").select(F.col("user_id").alias("actor")).distinct())


@query("a08_confiscation", "SELECT event_id % 500 AS target, CAST(greatest(0, sum(CASE event_type WHEN 'view' THEN 1 ELSE -1 END)) AS BIGINT) AS taken FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def _(spark, d):
    return C.confiscate(changes(spark, d), "target", "VOTE_CHANGE")


# Listings.
def _listing(name: str, order, order_sql: str, score, score_sql: str):
    @query(name, f"SELECT id, board, {score_sql} AS score FROM ({COUNTED}) WHERE status <> 'P' ORDER BY {order_sql} LIMIT 30")
    def run(spark, d):
        rows = counted_posts(spark, d).where(F.col("status") != "P").withColumn("score", score())
        return C.page(rows, order(), 30).select("id", "board", "score")


_HOT = "round(log10(greatest(1, up - down)) + (floor(epoch(created)) - 1704067200) / 45000, 6)"
_listing("f01_hot_listing", lambda: [F.desc("score"), F.desc("created"), F.desc("id")], "score DESC, created DESC, id DESC", lambda: F.round(S.hot_score(F.col("up"), F.col("down"), F.col("created")), 6), _HOT)
_listing("o01_new", lambda: [F.desc("created"), F.desc("id")], "created DESC, id DESC", lambda: F.col("up"), "up")
_listing("o03_discussed", lambda: [F.desc("score"), F.desc("created"), F.desc("id")], "score DESC, created DESC, id DESC", lambda: S.discussed_score(F.col("up"), F.col("down"), F.col("comments")), "2 * comments + (up - down)")
_listing("o04_top_net", lambda: [F.desc("score"), F.desc("created"), F.desc("id")], "score DESC, created DESC, id DESC", lambda: F.col("up") - F.col("down"), "up - down")
_listing("o05_top_page", lambda: [F.desc(F.col("board") == "1-URGENT"), F.desc("score"), F.desc("created"), F.desc("id")], "board = '1-URGENT' DESC, score DESC, created DESC, id DESC", lambda: F.col("up"), "up")


@query("o06_page", f"SELECT id, board FROM ({POSTS}) ORDER BY created DESC, id DESC LIMIT 30 OFFSET 60")
def _(spark, d):
    return C.page(posts(spark, d), [F.desc("created"), F.desc("id")], 30, 60).select("id", "board")


@query("o07_lookahead", f"SELECT count(*) > 30 AS has_more, least(count(*), 30) AS shown FROM (SELECT id FROM ({POSTS}) ORDER BY created DESC, id DESC LIMIT 31 OFFSET 60)")
def _(spark, d):
    rows = C.page(posts(spark, d), [F.desc("created"), F.desc("id")], 31, 60).agg(F.count("*").alias("n"))
    return rows.select((F.col("n") > 30).alias("has_more"), F.least("n", F.lit(30)).cast("long").alias("shown"))


@query("o08_page_info", f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 30.0)) AS BIGINT) AS pages, CAST(least(200, greatest(1, ceil(count(*) / 30.0))) AS BIGINT) AS page FROM ({POSTS}) WHERE status = 'P'")
def _(spark, d):
    return C.page_info(posts(spark, d).where(F.col("status") == "P"), 30, 200)


# Search.
@query("p13_fts", r"SELECT doc_id, source FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'that', 'with'])")
def _(spark, d):
    return table(spark, d, "documents").where(S.has_all_tokens(F.col("text"), "the that with")).select("doc_id", "source")


@query("p10_ilike", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%the_on%' AND lang IN ('en', 'fr')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%the_on%") & F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("p11_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_type), 'steel')")
def _(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("ar")) | F.contains(F.lower("p_type"), F.lit("steel"))).select("p_partkey", "p_name")


_AUTHORS = "LEFT JOIN customer c ON c.c_custkey = p.actor LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"


@query("j01_author_search", f"SELECT id, c_name, n_name, r_name FROM ({POSTS}) p {_AUTHORS} WHERE (n_name ILIKE '%n%1%' OR r_name ILIKE '%r%2%') AND status = 'O' ORDER BY created DESC, id DESC LIMIT 50")
def _(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = posts(spark, d).where(F.col("status") == "O").join(c, F.col("actor") == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    found = rows.where(F.col("n_name").ilike("%n%1%") | F.col("r_name").ilike("%r%2%"))
    return C.page(found, [F.desc("created"), F.desc("id")], 50).select("id", "c_name", "n_name", "r_name")


# Joins.
@query("j06_vote_overlay", """WITH v AS (SELECT event_id % 500 AS id, arg_max(CASE WHEN event_type = 'view' THEN 1 ELSE -1 END, event_id) AS mine FROM events WHERE user_id = 7 AND event_type IN ('view', 'error') GROUP BY 1)
SELECT o_orderkey AS id, CAST(coalesce(mine, 0) AS BIGINT) AS mine FROM orders LEFT JOIN v ON v.id = o_orderkey""")
def _(spark, d):
    own = ledger(spark, d).where(F.col("actor") == 7).groupBy((F.col("event_id") % 500).alias("id")).agg(F.max_by("delta", "event_id").alias("mine"))
    return posts(spark, d).join(own, "id", "left").select("id", F.coalesce("mine", F.lit(0)).cast("long").alias("mine"))


@query("j08_banned_semi", f"SELECT id, actor FROM ({POSTS}) WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = actor AND c_acctbal < 0)")
def _(spark, d):
    banned = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("actor"))
    return posts(spark, d).join(banned, "actor", "left_semi").select("id", "actor")


@query("j09_unacted_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, d):
    acted = posts(spark, d).where(F.col("status") == "F").select(F.col("actor").alias("c_custkey"))
    return table(spark, d, "customer").join(acted, "c_custkey", "left_anti").select("c_custkey")


@query("j11_latest_per_board", f"SELECT board, id, row_number() OVER (PARTITION BY board ORDER BY created DESC, id DESC) AS place FROM ({POSTS}) QUALIFY place <= 2")
def _(spark, d):
    return C.first_per_group(posts(spark, d), "board", [F.desc("created"), F.desc("id")], 2).select("board", "id", "place")


@query("j14_related", f"""WITH p AS ({POSTS}), latest AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY created DESC, id DESC) AS k FROM p QUALIFY k <= 7)
SELECT p.id, l.id AS related, row_number() OVER (PARTITION BY p.id ORDER BY l.created DESC, l.id DESC) AS place FROM p JOIN latest l ON l.board = p.board AND l.id <> p.id QUALIFY place <= 6""")
def _(spark, d):
    # The 6 latest of a board but oneself are among its 7 latest: a table of 7 rows a board meets the posts.
    own = posts(spark, d)
    latest = C.first_per_group(own, "board", [F.desc("created"), F.desc("id")], 7).select("board", F.col("id").alias("related"), F.col("place").alias("k"))
    lists = latest.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("k", "related"))).alias("latest"))
    rows = own.join(lists, "board").withColumn("latest", F.slice(F.filter("latest", lambda x: x["related"] != F.col("id")), 1, 6))
    return rows.select("id", F.posexplode("latest").alias("pos", "x")).select("id", F.col("x.related").alias("related"), (F.col("pos") + 1).cast("long").alias("place"))


# Board statistics over the 72 hours before a time.
_AT = "1998-03-02 00:00:00"
_STATS = f"SELECT board, CAST(avg(up) AS DOUBLE) AS avg_up, count(*) AS n FROM ({COUNTED}) WHERE created BETWEEN TIMESTAMP '{_AT}' - INTERVAL 72 HOUR AND TIMESTAMP '{_AT}' AND status <> 'P' GROUP BY board"
_THRESHOLD = "CAST(CASE WHEN n < 30 THEN 10 ELSE greatest(8, ceil(avg_up * 2)) END AS BIGINT)"


def _stats(spark, d):
    recent = counted_posts(spark, d).where(S.trailing(F.col("created"), F.lit(_AT).cast("timestamp_ntz")) & (F.col("status") != "P"))
    rows = recent.groupBy("board").agg(F.avg("up").alias("avg_up"), F.count("*").alias("n"))
    return rows.withColumn("threshold", S.threshold(F.col("avg_up"), F.col("n")))


@query("a06_concept_stats", f"SELECT board, round(avg_up, 6) AS avg_up, n, {_THRESHOLD} AS threshold FROM ({_STATS})")
def _(spark, d):
    return _stats(spark, d).withColumn("avg_up", F.round("avg_up", 6))


@query("f03_concept_posts", f"SELECT id, c.board FROM ({COUNTED}) c LEFT JOIN ({_STATS}) s ON s.board = c.board WHERE up >= least(3, coalesce({_THRESHOLD}, 10)) AND up - down >= 0 AND up / greatest(1, up + down) >= 0.65")
def _(spark, d):
    # A board without recent posts has the threshold of few posts.
    rows = counted_posts(spark, d).join(_stats(spark, d).select("board", "threshold"), "board", "left").withColumn("threshold", F.coalesce("threshold", S.threshold(F.lit(0.0), F.lit(0))))
    return rows.where(S.concept(F.col("up"), F.col("down"), F.least(F.lit(3), "threshold"))).select("id", "board")


@query("a10_counter_rebuild", "SELECT o_orderkey AS id, count(l_orderkey) AS comments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    return counted_posts(spark, d).select("id", "comments")


@query("a12_status_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(DISTINCT o_custkey) AS actors FROM orders")
def _(spark, d):
    return posts(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "O").alias("open"), F.count_if(F.col("status") == "F").alias("filled"), F.count_distinct("actor").alias("actors"))


# Votes: events as clicks of a user on one of 20 targets.
_CLICKS = "SELECT event_id, ts, user_id AS voter, event_id % 20 AS target, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS value FROM events"
_FOLD = f"""WITH c AS ({_CLICKS}), r AS (SELECT *, sum(CASE WHEN value = prev THEN 0 ELSE 1 END) OVER (PARTITION BY voter, target ORDER BY ts, event_id) AS run
FROM (SELECT *, lag(value) OVER (PARTITION BY voter, target ORDER BY ts, event_id) AS prev FROM c)),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY voter, target, run ORDER BY ts, event_id) % 2 = 1 THEN value ELSE 0 END AS state FROM r)"""


def _votes(spark, d):
    value = F.when(F.col("event_type").isin("view", "click"), 1).otherwise(-1)
    clicks = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("voter"), (F.col("event_id") % 20).alias("target"), value.alias("value"))
    return C.fold_votes(clicks, ["voter", "target"], ["ts", "event_id"])


@query("t04_vote_totals", f"""{_FOLD}, last AS (SELECT voter, target, arg_max(state, (ts, event_id)) AS state FROM f GROUP BY 1, 2)
SELECT target, count(*) FILTER (state = 1) AS up, count(*) FILTER (state = -1) AS down FROM last GROUP BY target""")
def _(spark, d):
    last = _votes(spark, d).groupBy("voter", "target").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return last.groupBy("target").agg(F.count_if(F.col("state") == 1).alias("up"), F.count_if(F.col("state") == -1).alias("down"))


@query("w09_first_promotion", f"""{_FOLD}, g AS (SELECT *, state - coalesce(lag(state) OVER (PARTITION BY voter, target ORDER BY ts, event_id), 0) AS move, state AS now FROM f),
u AS (SELECT target, ts, event_id, sum(CAST(now = 1 AS INT) - CAST(now - move = 1 AS INT)) OVER (PARTITION BY target ORDER BY ts, event_id) AS up FROM g)
SELECT target, min(ts) AS best_at FROM u WHERE up >= 3 GROUP BY target""")
def _(spark, d):
    before = F.coalesce(F.lag("state").over(Window.partitionBy("voter", "target").orderBy("ts", "event_id")), F.lit(0))
    moves = _votes(spark, d).withColumn("move", (F.col("state") == 1).cast("int") - (before == 1).cast("int"))
    return C.first_reached(moves, "target", ["ts", "event_id"], "move", 3, F.date_trunc("hour", "ts"))


@query("f05_content_points", f"""{_FOLD}, last AS (SELECT voter, target, arg_max(state, (ts, event_id)) AS state FROM f GROUP BY 1, 2)
SELECT target, CAST(sum(state) AS BIGINT) AS points FROM last GROUP BY target""")
def _(spark, d):
    # Each click's change of points, added up: a content's points so far.
    before = F.coalesce(F.lag("state").over(Window.partitionBy("voter", "target").orderBy("ts", "event_id")), F.lit(0))
    moves = _votes(spark, d).withColumn("delta", S.points_change(before, F.col("state")))
    return moves.groupBy("target").agg(F.sum("delta").cast("long").alias("points"))


# Limits.
def _limit(name: str, unit: str, limit: int):
    @query(name, f"""SELECT user_id, {bucket(unit, 'ts')} AS bucket, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) <= {limit}""")
    def run(spark, d):
        rows = C.calendar_limit(table(spark, d, "events"), ["user_id"], S.bucket_start(unit, F.col("ts")), ["ts", "event_id"], limit)
        return rows.where("admitted").select("user_id", "bucket", "event_id")


_limit("t01_daily_limit", "day", 2)
_limit("t02_hourly_limit", "hour", 1)


@query("t05_cooldown", """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 21600 SECOND) FROM a WHERE a.ts IS NOT NULL)
SELECT user_id, count(ts) AS admitted, max(ts) AS last FROM a WHERE ts IS NOT NULL GROUP BY user_id""")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id")
    kept = R.fold(events, "user_id", ["ts", "event_id"], ["ts"], R.cooldown(21_600)).where("admitted")
    return kept.groupBy("user_id").agg(F.count("*").alias("admitted"), F.max("ts").alias("last"))


@query("t08_replay", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(spark, d):
    return C.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("t09_view_dedup", "SELECT user_id, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS bucket, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id", S.epoch_bucket(F.col("ts"), 600).alias("bucket")).agg(F.count("*").alias("n"))


# Runs and rings.
@query("w04_run_groups", """WITH r AS (SELECT *, CAST(sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS size FROM r GROUP BY 1, 2""")
def _(spark, d):
    return C.runs_of(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("w05_last_n", "SELECT conv_id, turn, CAST(greatest(0, count(*) OVER (PARTITION BY conv_id) - 3) AS BIGINT) AS hidden FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _(spark, d):
    return C.keep_last(table(spark, d, "conversations"), "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "hidden")


@query("o12_recent_distinct", "SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC) <= 3")
def _(spark, d):
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return C.first_per_group(latest, "user_id", [F.desc("last")], 3).drop("place")


@query("o13_argmin", f"SELECT board, id, comments FROM ({COUNTED}) QUALIFY row_number() OVER (PARTITION BY board ORDER BY comments, id) = 1")
def _(spark, d):
    return counted_posts(spark, d).groupBy("board").agg(F.min_by("id", F.struct("comments", "id")).alias("id"), F.min("comments").alias("comments"))


# Threads: comments whose bodies name the one that they answer.
_COMMENTS = """SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 3 THEN NULL WHEN event_id % 13 = 5 THEN (SELECT max(event_id) FROM events x WHERE x.event_id = e.event_id + 1) ELSE event_id // 3 END AS parent, event_type AS content FROM events e"""
_THREADS = f"""WITH RECURSIVE c AS ({_COMMENTS}), t AS (SELECT id, id AS root, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM c WHERE parent IS NULL
UNION ALL SELECT c.id, t.root, t.depth + 1, list_append(t.path, c.id) FROM c JOIN t ON c.parent = t.id)"""


@query("j07_reply_edges", f"SELECT id, coalesce(parent, -1) AS parent FROM ({_COMMENTS})")
def _(spark, d):
    return C.reply_edges(comments(spark, d)).fillna({"parent": -1})


@query("f19_reply_marker", f"SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN -1 WHEN event_id % 11 = 3 THEN event_id + 1000000000 WHEN event_id % 13 = 5 THEN event_id + 1 ELSE event_id // 3 END AS asked, event_type AS content FROM events")
def _(spark, d):
    return comments(spark, d).select("id", F.coalesce(S.reply_parent(F.col("body")).cast("long"), F.lit(-1)).alias("asked"), S.reply_body(F.col("body")).alias("content"))


@query("g01_thread", f"{_THREADS} SELECT id, root, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path FROM t")
def _(spark, d):
    paths = C.thread_paths(C.reply_edges(comments(spark, d)), "id", "parent")
    return paths.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("g02_tree", f"{_THREADS} SELECT id, root, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM t")
def _(spark, d):
    return C.thread_order(C.thread_paths(C.reply_edges(comments(spark, d)), "id", "parent"), "id").drop("path")


# Texts.
@query("f24_hash", "SELECT page_id, sha256(url || '|pepper') AS hashed FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.salted_hash(F.col("url"), "pepper").alias("hashed"))


@query("f27_mask", "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.mask(F.col("c_name")).alias("masked"))


@query("f29_sanitize", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '\son[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'gi'), 'javascript:', '', 'gi')) AS clean FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(S.sanitize(F.col("html")), 256).alias("clean"))


@query("f35_log_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'info' END AS level FROM events")
def _(spark, d):
    level = F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).otherwise("info")
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), level.alias("level"))


@query("f10_week_keys", "SELECT strftime(ts + INTERVAL 9 HOUR, '%G-W%V') AS week, strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(S.week_key(F.col("ts")).alias("week"), S.month_key(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))


# Writes.
@query("m02_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'CHANGED' FROM customer WHERE c_custkey % 100 = 0")
def _(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changed = base.where("c_custkey % 10 = 0").unionByName(base.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return C.upsert(base, changed.withColumn("c_mktsegment", F.lit("CHANGED")), "c_custkey", ["c_mktsegment"])


@query("m12_backfill", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt:' || c_mktsegment ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat(F.lit("debt:"), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"))


@query("w07_gaps", "SELECT user_id, event_id, prev FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE event_id > prev + 100")
def _(spark, d):
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", prev.alias("prev")).where("event_id > prev + 100")


@query("u01_union_routes", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', c_custkey FROM customer")
def _(spark, d):
    a = posts(spark, d).where("status = 'P'").select(F.lit("order").alias("kind"), "id")
    return a.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("s13_sitemap", f"SELECT id FROM ({POSTS}) WHERE status = 'O' ORDER BY created DESC, id DESC LIMIT 200")
def _(spark, d):
    return C.page(posts(spark, d).where("status = 'O'"), [F.desc("created"), F.desc("id")], 200).select("id")
