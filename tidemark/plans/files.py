"""Queries on state files, front matter, logs, appended rows, request parameters and event routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import parameters as P
from ..sources import files as X
from ..sources.seeds import seed_posts
from ..sources.tables import posts, shared_folder, table
from .registry import POSTS, query

_STATE = "version string, cursor long, day string, failures int, error string"
_DEFAULTS = {"version": "0", "cursor": 0, "day": "1970-01-01", "failures": 3}


@query("s07_state", f"SELECT 'v2' AS version, max(id) AS cursor, '1970-01-01' AS day, 3 AS failures, CAST(NULL AS VARCHAR) AS error FROM ({POSTS})")
def _(spark, d):
    folder = shared_folder(spark, "state")
    X.save_state(posts(spark, d).agg(F.lit("v1").alias("version"), F.max("id").alias("cursor")), folder)
    return X.load_state(spark, folder, _STATE, _DEFAULTS, fixed={"version": "v2"})


@query("s07_missing_state", f"SELECT status, '0' AS version, 0 AS cursor, 3 AS failures, count(*) AS ahead FROM ({POSTS}) WHERE id > 0 GROUP BY 1")
def _(spark, d):
    # Without a file, the default cursor: all posts are ahead.
    state = X.load_state(spark, shared_folder(spark, "no-state"), _STATE, _DEFAULTS)
    ahead = posts(spark, d).join(F.broadcast(state), F.col("id") > F.col("cursor"))  # one row
    return ahead.groupBy("status", "version", "cursor", "failures").agg(F.count("*").alias("ahead"))


@query("s07_null_state", f"SELECT 'v2' AS version, max(id) AS cursor, CAST(NULL AS VARCHAR) AS day, 3 AS failures, CAST(NULL AS VARCHAR) AS error FROM ({POSTS})")
def _(spark, d):
    # What a file sets to null stays null.
    folder = shared_folder(spark, "null-state")
    X.save_state(posts(spark, d).agg(F.max("id").alias("cursor"), F.lit(None).cast("string").alias("day")), folder)
    return X.load_state(spark, folder, _STATE, _DEFAULTS, fixed={"version": "v2"})


@query("s15_state_sink", f"SELECT status, count(*) AS n FROM ({POSTS}) WHERE status = 'O' GROUP BY 1")
def _(spark, d):
    folder = shared_folder(spark, "saved")
    for status in ("F", "O"):  # the second replaces the first
        X.save_state(posts(spark, d).where(F.col("status") == status).groupBy("status").agg(F.count("*").alias("n")), folder)
    return spark.read.schema("status string, n long").json(folder)


@query("s08_front_matter", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS VARCHAR) ELSE '15' END AS minutes, CASE WHEN n_nationkey % 4 <> 0 THEN '2' ELSE '1' END AS posts,
CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS board, CASE WHEN n_nationkey % 4 <> 0 THEN 'Hello --- ' || n_name ELSE n_name || ' alone' END AS body FROM nation""")
def _(spark, d):
    id_, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    matter = F.concat(F.lit("\n---\ninterval_minutes_min: "), id_, F.lit("  # of a loop\nquotas:\n  per_loop:\n    max_new_posts: 2\n    max_votes: 5\ntargets:\n  boards:\n    - slug: \""), name, F.lit("\"\n      limit: 20\n    - slug: other\n---\n\n"))
    text = F.when(F.col("n_nationkey") % 4 != 0, F.concat(matter, F.lit("Hello --- "), name)).otherwise(F.concat(name, F.lit(" alone")))
    parts = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), D.front_matter(text).alias("parts"))
    rows = parts.select("id", "parts.body", D.settings(F.col("parts.matter")).alias("found"))
    asked = {"minutes": ("interval_minutes_min", "15"), "posts": ("quotas.per_loop.max_new_posts", "1"), "board": ("targets.boards.slug", None)}
    return rows.select("id", *(D.setting(F.col("found"), path, default).alias(c) for c, (path, default) in asked.items()), "body")


@query("s08_boards", """SELECT n_nationkey AS id, n_name AS slug, 20 + n_nationkey AS read_limit FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, 'b' || n_regionkey, 20 FROM nation WHERE n_nationkey % 4 <> 0""")
def _(spark, d):
    # One row for each board of a document that has a slug, with its own limit or the default.
    id_, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    boards = F.concat(F.lit("---\ntargets:\n  boards:\n    - slug: \""), name, F.lit("\"\n      per_loop_read_limit: "), (F.col("n_nationkey") + 20).cast("string"), F.lit("\n    - per_loop_read_limit: 7\n    - slug: b"), F.col("n_regionkey").cast("string"), F.lit("\nquotas:\n  slug: none\n---\nbody"))
    text = F.when(F.col("n_nationkey") % 4 != 0, boards).otherwise(F.concat(F.lit("--- "), id_))
    found = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(D.entries(D.front_matter(text)["matter"], "targets.boards")).alias("board"))
    rows = found.select("id", D.setting(F.col("board"), "slug").alias("slug"), D.setting(F.col("board"), "per_loop_read_limit", "20").cast("int").alias("read_limit"))
    return rows.where("slug is not null")


@query("s10_log_tail", """WITH t AS (SELECT event_id AS seq, event_type || ' ' || props AS line FROM events WHERE event_id > 100 ORDER BY seq DESC LIMIT 200),
s AS (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY seq DESC) AS bytes FROM t)
SELECT seq, line, (SELECT count(*) FROM events WHERE event_id > 100) > (SELECT count(*) FROM s WHERE bytes <= 3000) AS cut FROM s WHERE bytes <= 3000""")
def _(spark, d):
    lines = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "props").alias("line"))
    return X.log_tail(lines, 100, 200, 3_000)


@query("s16_seed", """SELECT id, ['free', 'news', 'help'][id % 3 + 1] AS board, c_custkey AS actor, ['free', 'news', 'help'][id % 3 + 1] || ' #' || (id // 3) AS title,
TIMESTAMP '2024-01-01 00:00:00' + to_hours(id) AS created, id < 3 AS pinned FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer WHERE c_custkey <= 700)
WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(spark, d):
    # A post for each of the first actors, but for those whose id is there: seeding again adds nothing.
    actors = table(spark, d, "customer").where("c_custkey <= 700").select(F.col("c_custkey").alias("actor"))
    return seed_posts(actors).join(posts(spark, d).where("status = 'F'").select("id"), "id", "left_anti")


@query("m01_append", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def _(spark, d):
    folder, rows = shared_folder(spark, "inserted"), table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    X.append(rows, folder)
    X.append(rows.where("c_nationkey = 3"), folder)
    return spark.read.parquet(folder).select("c_custkey", "c_name")


@query("p28_routing", """SELECT event_id FROM (SELECT event_id, event_type AS stream, CASE user_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'side' END AS session, 'r' || (event_id % 4) AS run, CASE WHEN event_id % 5 > 0 THEN 'c' END AS call FROM events)
WHERE stream = 'click' AND (session IS NULL OR session = 'main') AND run = 'r1' AND call IS NOT NULL""")
def _(spark, d):
    user, event = F.col("user_id"), F.col("event_id")
    stream = F.when(F.col("event_type") == "click", "tool").otherwise(F.col("event_type"))
    session = F.when(user % 3 == 0, "main").when(user % 3 == 1, "side").when(user % 2 == 0, "")
    test = P.routed(stream, session, F.concat(F.lit("r"), event % 4), F.when(event % 5 > 0, "c"), F.lit("main"), F.lit("r1"))
    return table(spark, d, "events").where(test).select("event_id")


@query("p29_allowed", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'hot' WHEN event_type = 'click' THEN 'top' ELSE 'new' END AS sort FROM events")
def _(spark, d):
    asked = F.when(F.col("event_type") == "view", "hot").when(F.col("event_type") == "click", "top").when(F.col("event_type") == "error", "Hot").when(F.col("event_type") == "signup", "")
    return table(spark, d, "events").select("event_id", P.allowed(asked, P.SORTS, "new").alias("sort"))


@query("p30_checks", """SELECT event_id, CAST(CASE WHEN event_id % 7 IN (0, 1, 2) THEN 30 WHEN event_id % 7 = 6 THEN 50 ELSE least(event_id % 80 + 1, 50) END AS BIGINT) AS page_limit,
CASE WHEN event_id % 4 IN (1, 3) THEN 'SHORT' WHEN event_id % 4 = 2 THEN 'LONG' END AS text, CASE WHEN event_id > 200 THEN 'DEEP' END AS page FROM events""")
def _(spark, d):
    event = F.col("event_id")
    n = (event % 80 + 1).cast("string")
    asked = F.when(event % 7 == 1, F.concat(F.lit("-"), n)).when(event % 7 == 2, F.concat(F.lit("x"), n)).when(event % 7 == 3, F.concat(F.lit(" "), n, F.lit("px"))).when(event % 7 == 6, F.concat(n, F.repeat(F.lit("9"), 20))).when(event % 7 > 3, n)
    text = F.when(event % 4 == 1, F.lit("  a ")).when(event % 4 == 2, F.repeat(F.lit("ab "), 41)).when(event % 4 == 3, F.lit("\u3000a\u3000")).otherwise(F.when(event % 8 == 0, "").otherwise("ab"))
    return table(spark, d, "events").select("event_id", P.limit(asked).cast("long").alias("page_limit"), P.query_error(text).alias("text"), P.page_error(event).alias("page"))


@query("o15_default_first", "SELECT n_nationkey AS id, row_number() OVER (ORDER BY n_nationkey % 9 = 4 DESC, lower(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END), n_nationkey) AS place FROM nation")
def _(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(" "))
    label = F.when(F.btrim(name) != "", name).otherwise(F.col("n_nationkey").cast("string"))
    order = Window.orderBy(F.desc(F.col("n_nationkey") % 9 == 4), F.lower(label), "n_nationkey")  # one row a nation
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.row_number().over(order).cast("long").alias("place"))
