"""Queries on scans, filters, joins, aggregates and orders of listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import writes as W
from ..sources.tables import counted_posts, ledger, posts, table
from .registry import COUNTED, LEDGER, NOW, POSTS, bucket, now, query


@query("s01_ordered_scan", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_name")


@query("s02_point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey")


@query("s03_first_match", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(spark, d):
    return C.page(table(spark, d, "orders").where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 1).select("o_orderkey")


@query("s04_fallback_lookup", "SELECT asked, coalesce(a.n_nationkey, b.n_nationkey, -1) AS found FROM (VALUES ('NATION_3'), ('nation_4'), ('nowhere')) v(asked) LEFT JOIN nation a ON a.n_name = asked LEFT JOIN nation b ON b.n_name = upper(asked)")
def _(spark, d):
    asked = spark.createDataFrame([("NATION_3",), ("nation_4",), ("nowhere",)], "asked string")
    n = F.broadcast(table(spark, d, "nation").select("n_name", "n_nationkey"))  # one row a nation
    rows = asked.join(n.alias("a"), F.col("a.n_name") == F.col("asked"), "left").join(n.alias("b"), F.col("b.n_name") == F.upper("asked"), "left")
    return rows.select("asked", F.coalesce("a.n_nationkey", "b.n_nationkey", F.lit(-1)).alias("found"))


@query("s05_sql_source", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(spark, d):
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY 1", args={"least": 100_000}, orders=table(spark, d, "orders"))


@query("s06_constant_relation", f"SELECT key, place, count(id) AS n FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('none', 3)) v(key, place) LEFT JOIN ({POSTS}) ON board = key GROUP BY 1, 2")
def _(spark, d):
    fixed = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("none", 3)], "key string, place int")
    counts = posts(spark, d).groupBy(F.col("board").alias("key")).agg(F.count("*").alias("n"))
    return fixed.join(counts, "key", "left").select("key", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("s11_sequence_gaps", "SELECT board, before + 1 AS expected, o_orderkey AS received FROM (SELECT o_orderpriority AS board, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderkey > before + 1")
def _(spark, d):
    return C.gaps(posts(spark, d), "board", "id", block=1000)


@query("p02_nested_author", "SELECT o_orderkey, c_name AS name, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    author = F.struct(F.col("c_name").alias("name"), F.struct("n_name").alias("nation")).alias("author")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("o_orderkey", author)
    return rows.select("o_orderkey", "author.name", F.col("author.nation.n_name").alias("nation"))


@query("p04_optional_filters", f"SELECT id FROM ({COUNTED}) WHERE status = 'O' AND board = '2-HIGH' AND up >= 2")
def _(spark, d):
    asked = {"status": "O", "board": "2-HIGH", "actor": None}
    tests = [F.col(k) == v for k, v in asked.items() if v is not None] + [F.col("up") >= 2]
    return counted_posts(spark, d).where(reduce(lambda a, b: a & b, tests, F.lit(True))).select("id")


@query("p06_empty_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 5, 8) OR o_orderkey IN (-1)")
def _(spark, d):
    return table(spark, d, "orders").where(F.col("o_custkey").isin(3, 5, 8) | F.col("o_orderkey").isin([])).select("o_orderkey")


@query("p09_unexpired", f"SELECT event_id FROM events WHERE (event_id % 4 = 0) OR ts > {NOW}")
def _(spark, d):
    expires = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    return table(spark, d, "events").where(expires.isNull() | (expires > now())).select("event_id")


@query("p12_starts_with", "SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') OR starts_with(c_mktsegment, 'AUTO')")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.where(F.startswith("c_name", F.lit("Customer#00000001")) | F.startswith("c_mktsegment", F.lit("AUTO"))).select("c_custkey")


@query("p21_owner_check", "SELECT asked, owner, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = asked AND o_custkey = owner) AS owns FROM (SELECT o_orderkey AS asked, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS owner FROM orders)")
def _(spark, d):
    own = posts(spark, d).select("id", "actor")
    asked = own.select(F.col("id").alias("asked"), F.when(F.col("id") % 3 == 0, F.col("actor")).otherwise(F.col("actor") + 1).alias("owner"))
    found = asked.join(own, (F.col("id") == F.col("asked")) & (F.col("actor") == F.col("owner")), "left")
    return found.select("asked", "owner", F.col("id").isNotNull().alias("owns"))


def _tab(name: str, test, sql: str):
    @query(f"p14_tab_{name}", f"SELECT id FROM ({COUNTED}) WHERE {sql}")
    def run(spark, d):
        return counted_posts(spark, d).where(test()).select("id")


_tab("concept", lambda: F.col("up") >= 3, "up >= 3")
_tab("notice", lambda: F.col("board") == "1-URGENT", "board = '1-URGENT'")


@query("p15_author_kind", "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark, d):
    agents = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("actor"))
    return posts(spark, d).join(agents, "actor", "left_semi").select("id")


@query("p16_scope_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(source), 'tion the')")
def _(spark, d):
    found = [F.contains(F.lower(c), F.lit("tion the")) for c in ("text", "source")]
    return table(spark, d, "documents").where(found[0] | found[1]).select("doc_id")


@query("p17_author_search", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND contains(lower(c_name), '00042'))")
def _(spark, d):
    named = table(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("00042"))).select(F.col("c_custkey").alias("actor"))
    return posts(spark, d).join(named, "actor", "left_semi").select("id")


# Bans: customers with a negative balance, everywhere if the nation is 0 to 9, else on the board of their segment's first letter.
@query("p19_ban_scope", f"""SELECT id FROM ({POSTS}) p WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = actor AND c_acctbal < 0 AND (c_nationkey < 10 OR board = CASE WHEN c_mktsegment = 'BUILDING' THEN '1-URGENT' ELSE '5-LOW' END))""")
def _(spark, d):
    board = F.when(F.col("c_nationkey") >= 10, F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").otherwise("5-LOW"))
    bans = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("banned"), board.alias("where"))
    return posts(spark, d).join(bans, (F.col("actor") == F.col("banned")) & (F.col("where").isNull() | (F.col("where") == F.col("board"))), "left_anti").select("id")


@query("p20_candidates", f"SELECT id FROM ({POSTS}) WHERE board <> '1-URGENT' AND id NOT IN (SELECT DISTINCT event_id FROM events WHERE event_type = 'click')")
def _(spark, d):
    acted = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"))
    return posts(spark, d).where(F.col("board") != "1-URGENT").join(acted, "id", "left_anti").select("id")


@query("j02_search_count", f"SELECT count(*) AS n FROM ({POSTS}) p LEFT JOIN customer c ON c.c_custkey = p.actor LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE (n_name ILIKE '%n%1%' OR r_name ILIKE '%r%2%') AND status = 'O'")
def _(spark, d):
    # An author's names decide, so the matching authors are found first, and the posts are counted by a semi-join.
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    authors = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    named = authors.where(F.col("n_name").ilike("%n%1%") | F.col("r_name").ilike("%r%2%")).select(F.col("c_custkey").alias("actor"))
    return posts(spark, d).where("status = 'O'").join(named, "actor", "left_semi").agg(F.count("*").alias("n"))


@query("j04_late_columns", "WITH t AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders JOIN t USING (o_orderkey)")
def _(spark, d):
    o = table(spark, d, "orders")
    ids = C.page(o.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey")
    return o.join(F.broadcast(ids), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("j05_leader_names", f"""WITH p AS (SELECT actor, CAST(sum(delta) AS BIGINT) AS points FROM ({LEDGER}) GROUP BY actor ORDER BY points DESC, actor LIMIT 10)
SELECT actor, points, CASE WHEN c_nationkey < 15 THEN c_name ELSE 'unnamed' END AS name FROM p LEFT JOIN customer ON c_custkey = actor""")
def _(spark, d):
    names = table(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("actor"), F.col("c_name").alias("name"))
    top = C.top_points(ledger(spark, d), 10)
    return names.join(F.broadcast(top), "actor", "right").select("actor", "points", F.coalesce("name", F.lit("unnamed")).alias("name"))


@query("j12_claim_owner", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'gone' WHEN c_acctbal < 0 THEN 'conflict' ELSE 'ok' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 7")
def _(spark, d):
    owners = table(spark, d, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    outcome = F.when(F.col("c_acctbal").isNull(), "gone").when(F.col("c_acctbal") < 0, "conflict").otherwise("ok")
    return table(spark, d, "orders").join(owners, "o_custkey", "left").select("o_orderkey", outcome.alias("outcome"))


@query("j13_merged_sources", "SELECT coalesce(s_suppkey, p_partkey) AS id, coalesce(s_name, p_name) AS name FROM supplier FULL JOIN part ON s_suppkey = p_partkey")
def _(spark, d):
    a, b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return a.join(b, "id", "full_outer").select("id", F.coalesce("s_name", "p_name").alias("name"))


@query("a04_actor_total", f"SELECT CAST(coalesce(sum(delta), 0) AS BIGINT) AS points FROM ({LEDGER}) WHERE actor = 7 AND ts >= {bucket('month', NOW)}")
def _(spark, d):
    from ..functions import scoring as S

    return ledger(spark, d).where((F.col("actor") == 7) & (F.col("ts") >= S.bucket_start("month", now()))).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("points"))


@query("a05_groups_above", f"WITH p AS (SELECT actor, sum(delta) AS points FROM ({LEDGER}) GROUP BY actor) SELECT count(*) AS above FROM p WHERE points > (SELECT points FROM p WHERE actor = 7) OR (points = (SELECT points FROM p WHERE actor = 7) AND actor < 7)")
def _(spark, d):
    one = spark.createDataFrame([(7,)], "actor long")
    return C.rank_of(ledger(spark, d), one).select((F.col("rank") - 1).alias("above"))


@query("a09_incremental_points", f"SELECT actor, CAST(sum(delta) AS BIGINT) AS points FROM ({LEDGER}) GROUP BY 1")
def _(spark, d):
    # The sums as they were, then increased by what came since: as a stream, `streaming.limits.running_points` does the same.
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    sums = lambda rows: rows.groupBy("actor").agg(F.sum("delta").alias("points"))
    return W.increment(sums(ledger(spark, d).where(F.col("ts") < since)), sums(ledger(spark, d).where(F.col("ts") >= since)), "actor", "points")


@query("a13_buckets", "SELECT CASE WHEN p_type IN ('STANDARD', 'PROMO') THEN p_type ELSE 'other' END AS bucket, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.when(F.col("p_type").isin("STANDARD", "PROMO"), F.col("p_type")).otherwise("other").alias("bucket")).agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


@query("a14_distinct_actors", "SELECT DISTINCT user_id FROM events")
def _(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


@query("a15_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return C.keep_first(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


@query("a16_tallies", "SELECT count(*) AS processed, count(*) FILTER (c_acctbal < 0) AS filled, count(*) FILTER (c_acctbal >= 0 AND c_nationkey = 3) AS skipped FROM customer")
def _(spark, d):
    balance = F.col("c_acctbal")
    return table(spark, d, "customer").agg(F.count("*").alias("processed"), F.count_if(balance < 0).alias("filled"), F.count_if((balance >= 0) & (F.col("c_nationkey") == 3)).alias("skipped"))


@query("a17_any", "SELECT doc_id, contains(lower(text), 'der') OR contains(lower(text), 'ction') AS found FROM documents")
def _(spark, d):
    words = F.array(F.lit("der"), F.lit("ction"))
    return table(spark, d, "documents").select("doc_id", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("found"))


@query("a18_probe", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e6) AS found")
def _(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1e6").limit(1).agg((F.count("*") > 0).alias("found"))


@query("o09_cursor", "SELECT o_orderkey, to_base64(encode(CAST(o_orderkey AS VARCHAR))) AS cursor FROM orders")
def _(spark, d):
    cursor = F.base64(F.col("o_orderkey").cast("string").cast("binary"))
    return table(spark, d, "orders").withColumn("cursor", cursor).where(F.unbase64("cursor").cast("string").cast("long") == F.col("o_orderkey")).select("o_orderkey", "cursor")


@query("o10_keyset", "SELECT c_custkey FROM customer WHERE c_custkey > 120 ORDER BY c_custkey LIMIT 500")
def _(spark, d):
    return table(spark, d, "customer").where("c_custkey > 120").orderBy("c_custkey").limit(500).select("c_custkey")


@query("o14_priority_sort", "SELECT id, row_number() OVER (ORDER BY CASE board WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END, created DESC, id DESC) AS place FROM (SELECT * FROM (" + POSTS + ") ORDER BY CASE board WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 99 END, created DESC, id DESC LIMIT 50)")
def _(spark, d):
    at = F.array_position(F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT")), F.col("board"))
    order = [F.when(at == 0, 99).otherwise(at), F.desc("created"), F.desc("id")]
    top = C.page(posts(spark, d), order, 50)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 50 rows


@query("o16_feed", f"WITH t AS (SELECT * FROM ({COUNTED}) ORDER BY created DESC, id DESC LIMIT 30) SELECT id, board = '1-URGENT' AS pinned, up FROM t ORDER BY pinned DESC, up DESC, id DESC")
def _(spark, d):
    # The 30 latest are fetched first; "hot" then sorts those alone.
    rows = C.page(counted_posts(spark, d), [F.desc("created"), F.desc("id")], 30)
    return rows.select("id", (F.col("board") == "1-URGENT").alias("pinned"), "up").orderBy(F.desc("pinned"), F.desc("up"), F.desc("id"))


@query("o17_hint_order", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 50 END AS place FROM part ORDER BY place, p_partkey LIMIT 40")
def _(spark, d):
    place = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit(50))
    return table(spark, d, "part").select("p_partkey", place.alias("place")).orderBy("place", "p_partkey").limit(40)


@query("u02_ordered_union", "SELECT name, min(seed) AS seed FROM (SELECT n_name AS name, 0 AS seed FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT r_name, 2 FROM region) GROUP BY 1")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    parts = [n.where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit(0).alias("seed")), n.select(F.col("n_name").alias("name"), F.lit(1).alias("seed")), r.select(F.col("r_name").alias("name"), F.lit(2).alias("seed"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("name").agg(F.min("seed").alias("seed"))


@query("u03_key_union", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k,x' ELSE 'k' END AS keys FROM events")
def _(spark, d):
    own = F.map_keys(F.from_json("props", "map<string, int>"))
    other = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("k"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.array_union(own, other)), ",").alias("keys"))
