"""Queries on indexes, tables changed in place, kept ranks and threads, bucketed joins and pages: what is written once and read often.

Each writes what it needs into the shared folder when it is called and reads it back, so it equals the SQL of the plain form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scoring as S
from ..operators import community as C
from ..operators import folds as R
from ..operators import kept_threads as K
from ..operators import postings as P
from ..operators import ranking as N
from ..operators import writes as W
from ..sources import buckets as B
from ..sources import files as X
from ..sources import layout as L
from ..sources.tables import comments, ledger, posts, settled, shared_folder, table
from ..streaming import limits
from .queries import _AUTHORS, _THREADS
from .registry import FOUND, LEDGER, NOW, POSTS, now, query

#: Ids of a block in the laid-out tables of texts.
_BLOCK = 4_096


def _texts(spark, d):
    """(index of words, index of trigrams, laid-out table) of the documents."""
    docs = table(spark, d, "documents")
    words, grams, folder = P.Index(shared_folder(spark, "words")), P.Index(shared_folder(spark, "trigrams")), shared_folder(spark, "texts")
    return docs, words, grams, folder


@query("p13_index_search", FOUND["p13_fts"][1])
def _(spark, d):
    docs, words, _, folder = _texts(spark, d)
    P.add(words, docs, "doc_id", P.words(F.col("text")))
    P.lay_out(docs, "doc_id", folder, _BLOCK)
    return P.of_ids(spark, folder, "doc_id", P.search(spark, words, ["the", "that", "with"]), _BLOCK).select("doc_id", "source")


@query("p13_index_page", r"SELECT doc_id, source, (SELECT count(*) FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'that'])) AS total FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['the', 'that']) ORDER BY doc_id DESC LIMIT 30 OFFSET 60")
def _(spark, d):
    # A page of what was found, newest first, and how much there is: texts are read for the rows of the page only.
    docs, words, _, folder = _texts(spark, d)
    P.add(words, docs, "doc_id", P.words(F.col("text")))
    P.lay_out(docs, "doc_id", folder, _BLOCK)
    found = settled(P.search(spark, words, ["the", "that"]))
    page = settled(C.page(found, [F.desc("id")], 30, 60))
    return P.of_ids(spark, folder, "doc_id", page, _BLOCK).select("doc_id", "source", F.lit(found.count()).cast("long").alias("total"))


@query("p13_term_counts", r"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents) WHERE term IN ('the', 'that', 'und', 'nowhere') GROUP BY 1")
def _(spark, d):
    docs, words, _, _ = _texts(spark, d)
    # In two batches; the second replaces rows of the first.
    P.add(words, docs.where("doc_id % 2 = 0"), "doc_id", P.words(F.col("text")))
    P.add(words, docs.where("doc_id % 2 = 1"), "doc_id", P.words(F.col("text")))
    return P.counts(spark, words, ["the", "that", "und", "nowhere"])


@query("p13_index_replaced", r"SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN lang || ' with that' ELSE text END), '[\p{L}\p{N}_]+'), ['that', 'with'])")
def _(spark, d):
    docs, words, _, _ = _texts(spark, d)
    P.add(words, docs, "doc_id", P.words(F.col("text")))
    P.add(words, docs.where("doc_id % 3 = 0").withColumn("text", F.concat("lang", F.lit(" with that"))), "doc_id", P.words(F.col("text")), replaces=True)
    return P.search(spark, words, ["that", "with"]).select(F.col("id").alias("doc_id"))


@query("p10_trigram_search", FOUND["p10_ilike"][1])
def _(spark, d):
    docs, _, grams, folder = _texts(spark, d)
    P.add(grams, docs, "doc_id", P.trigrams(F.col("text")))
    P.lay_out(docs, "doc_id", folder, _BLOCK)
    return P.ilike(spark, grams, folder, "doc_id", "text", "%the_on%", _BLOCK).where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("p11_trigram_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'econ')")
def _(spark, d):
    part, grams, folder = table(spark, d, "part"), P.Index(shared_folder(spark, "types")), shared_folder(spark, "parts")
    P.add(grams, part, "p_partkey", P.trigrams(F.col("p_type")))
    P.lay_out(part, "p_partkey", folder, _BLOCK)
    return P.ilike(spark, grams, folder, "p_partkey", "p_type", "%ECon%", _BLOCK).select("p_partkey", "p_name")


@query("m02_upsert_in_place", FOUND["m02_upsert"][1])
def _(spark, d):
    base, kept = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), B.Table(shared_folder(spark, "customers"), "c_custkey")
    B.create(kept, base)
    changed = base.where("c_custkey % 10 = 0").unionByName(base.where("c_custkey % 100 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    B.upsert(spark, kept, changed.withColumn("c_mktsegment", F.lit("CHANGED")))
    return B.read(spark, kept)


@query("m12_backfill_in_place", FOUND["m12_backfill"][1])
def _(spark, d):
    kept = B.Table(shared_folder(spark, "customers"), "c_custkey", width=256)
    B.create(kept, table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment")))
    B.update_where(spark, kept, F.col("c_acctbal") < 0, {"segment": F.concat(F.lit("debt:"), "segment")})
    return B.read(spark, kept).select("c_custkey", "segment")


@query("m13_fill_in_place", FOUND["m13_fill_names"][1])
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("p_name"))
    kept = B.Table(shared_folder(spark, "parts"), "p_partkey", width=1_024)
    B.create(kept, rows)
    B.upsert(spark, kept, W.fill_names(B.read(spark, kept), "p_partkey", "p_name", "part#").where("filled").select("p_partkey", "p_name"))
    return B.read(spark, kept)


def _kept_ranks(spark, d):
    """The ledger in three batches."""
    ranks, rows = N.Ranks(shared_folder(spark, "ranks")), ledger(spark, d)
    N.create(spark, ranks)
    for k in range(3):
        N.apply(spark, ranks, rows.where(F.col("event_id") % 3 == k))
    return ranks


@query("w02_kept_ranks", f"SELECT actor, CAST(sum(delta) AS BIGINT) AS points, row_number() OVER (ORDER BY sum(delta) DESC, actor) AS rank FROM ({LEDGER}) GROUP BY actor")
def _(spark, d):
    return N.all_ranks(spark, _kept_ranks(spark, d))


@query("w02_kept_rank", f"""WITH p AS (SELECT actor, sum(delta) AS points FROM ({LEDGER}) GROUP BY actor), a AS (SELECT 7 AS actor, coalesce((SELECT points FROM p WHERE actor = 7), 0) AS points)
SELECT CAST(a.points AS BIGINT) AS points, 1 + (SELECT count(*) FROM p WHERE p.points > a.points OR (p.points = a.points AND p.actor < 7)) AS rank, (SELECT count(*) FROM p WHERE p.points > a.points) AS above FROM a""")
def _(spark, d):
    ranks = _kept_ranks(spark, d)
    points, rank = N.rank(spark, ranks, 7)
    return spark.createDataFrame([(points, rank, N.groups_above(spark, ranks, points))], "points long, rank long, above long")


def _kept_forest(spark, d):
    """The comments in four batches, replies often before what they answer."""
    forest = K.Forest(shared_folder(spark, "threads"))
    K.create(spark, forest)
    for k in (2, 0, 3, 1):
        K.add(spark, forest, comments(spark, d).where(F.col("id") % 4 == k))
    return K.paths(spark, forest)


@query("g01_kept_threads", FOUND["g01_thread"][1])
def _(spark, d):
    return _kept_forest(spark, d).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("g02_kept_tree", f"{_THREADS} SELECT id, root, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM t WHERE root % 5 = 0")
def _(spark, d):
    return C.thread_order(_kept_forest(spark, d).where("root % 5 = 0"), "id").drop("path")


def bucketed_authors(spark, d):
    """Posts with their authors' names and places: both large sides are read in buckets of the author."""
    own = L.bucketed(posts(spark, d), "actor", 16, "posts_by_actor")
    people = L.bucketed(table(spark, d, "customer").select(F.col("c_custkey").alias("actor"), "c_name", "c_nationkey"), "actor", 16, "people")
    n, r = (table(spark, d, t) for t in ("nation", "region"))
    rows = own.where(F.col("status") == "O").join(people.hint("merge"), "actor", "left")
    return rows.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # fixed lists of places


@query("j01_bucketed_authors", f"SELECT id, c_name, n_name, r_name FROM ({POSTS}) p {_AUTHORS} WHERE (n_name ILIKE '%n%1%' OR r_name ILIKE '%r%2%') AND status = 'O' ORDER BY created DESC, id DESC LIMIT 50")
def _(spark, d):
    found = bucketed_authors(spark, d).where(F.col("n_name").ilike("%n%1%") | F.col("r_name").ilike("%r%2%"))
    return C.page(found, [F.desc("created"), F.desc("id")], 50).select("id", "c_name", "n_name", "r_name")


@query("j04_bucketed_counts", "SELECT c_custkey AS actor, c_name, count(o_orderkey) AS posts, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def _(spark, d):
    own = L.bucketed(posts(spark, d), "actor", 16, "posts_by_actor")
    people = L.bucketed(table(spark, d, "customer").select(F.col("c_custkey").alias("actor"), "c_name"), "actor", 16, "people")
    return people.join(own.hint("merge"), "actor", "left").groupBy("actor", "c_name").agg(F.count("id").alias("posts"), F.max("created").alias("latest"))


_PAGE = 5_000
#: Rows in a range of a large keyset.
_RANGE = 1_000_000


@query("o10_keyset_pages", f"SELECT (k - 1) // {_PAGE} AS page, min(id) AS first, max(id) AS last, count(*) AS n FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")
def _(spark, d):
    keyset, told, state = L.Keyset(shared_folder(spark, "keyset"), "id"), shared_folder(spark, "pages"), shared_folder(spark, "cursor")
    rows, schema = posts(spark, d).select("id", "board"), "page long, first long, last long, n long"
    L.lay_out(keyset, rows, max(16, rows.count() // _RANGE))
    X.append(spark.createDataFrame([], schema), told)

    def work(pages):
        X.append(pages.groupBy("page").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")), told)

    L.each_run(spark, keyset, _PAGE, work, state)
    return spark.read.schema(schema).parquet(told)


@query("m14_audit_log", """SELECT CASE WHEN user_id % 2 = 0 THEN 'HUMAN' ELSE 'AGENT' END AS actor_type, user_id AS actor_id, event_type AS endpoint, 'POST' AS method, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
CASE WHEN event_id % 5 <> 0 THEN sha256('10.0.0.' || user_id || '|pepper') END AS ip, props AS user_agent, CAST(floor(value * 10) AS BIGINT) AS latency_ms FROM events""")
def _(spark, d):
    e, folder = table(spark, d, "events"), shared_folder(spark, "audit")
    ip = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("10.0.0."), "user_id")).when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 5 != 0, F.concat(F.lit("10.0.0."), "user_id"))
    rows = e.select("event_id", F.when(F.col("user_id") % 2 == 0, "HUMAN").otherwise("AGENT").alias("actor_type"), F.col("user_id").alias("actor_id"), F.col("event_type").alias("endpoint"), F.lit("POST").alias("method"),
                    F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), ip.alias("ip"), F.col("props").alias("user_agent"), F.floor(F.col("value") * 10).alias("latency_ms"))
    for k in range(2):
        X.log_audit(rows.where(F.col("event_id") % 2 == k).drop("event_id"), folder, "pepper")
    X.log_audit(rows.drop("event_id"), "nowhere://audit", "pepper")  # fails, and nobody notices
    return spark.read.parquet(folder)


_USERS = f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_name WHEN c_custkey % 2 = 0 THEN '' END AS nickname, CASE WHEN c_acctbal >= 0 THEN {NOW} END AS adult,
CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN '' END AS terms, CASE WHEN c_custkey % 11 > 0 THEN 'v1' END AS privacy FROM customer"""


@query("p24_onboarding_fields", f"SELECT id, coalesce(nickname <> '', false) AND adult IS NOT NULL AND coalesce(terms <> '', false) AND privacy IS NOT NULL AS done FROM ({_USERS})")
def _(spark, d):
    id_ = F.col("c_custkey")
    some = lambda test, value: F.when(test, value).when(id_ % 2 == 0, "")
    fields = [some(id_ % 7 > 0, F.col("c_name")), F.when(F.col("c_acctbal") >= 0, now()), some(id_ % 5 > 0, F.col("c_mktsegment")), F.when(id_ % 11 > 0, "v1")]
    return table(spark, d, "customer").select(id_.alias("id"), I.onboarded(*fields).alias("done"))


_NUMBERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


def _ring(name, most, moves):
    again = f"list_append(list_filter(r.ids, lambda x: x <> e.event_type), e.event_type)[-{most}:]" if moves else "r.ids"

    @query(name, f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT user_id, k, [event_type] AS ids, 0 AS gone FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, CASE WHEN list_contains(r.ids, e.event_type) THEN {again} ELSE list_append(r.ids, e.event_type)[-{most}:] END,
  r.gone + CASE WHEN NOT list_contains(r.ids, e.event_type) AND len(r.ids) = {most} THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, max(k) AS n, max(gone) AS evicted, arg_max(len(ids), k) AS kept FROM r GROUP BY 1""")
    def run(spark, d):
        rows = R.fold(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", ["event_id"], ["event_type"], R.ring(most, moves))
        return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count("evicted").alias("evicted"), F.max_by("kept", "event_id").alias("kept"))


_ring("t17_ring_of_calls", 3, False)
_ring("o12_ring_moved_to_front", 2, True)


@query("t14_cache_hits", """WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 10 HOUR) FROM a WHERE a.ts IS NOT NULL)
SELECT a.user_id, count(a.ts) AS computed, (SELECT count(*) FROM events e WHERE e.user_id = a.user_id) - count(a.ts) AS hits FROM a WHERE ts IS NOT NULL GROUP BY 1""")
def _(spark, d):
    rows = R.fold(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], ["ts"], R.cached(36_000))
    return rows.groupBy("user_id").agg(F.count_if(~F.col("hit")).alias("computed"), F.count_if("hit").alias("hits"))


@query("t20_flushes", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark, d):
    # A stream of the events, flushed into a table at an interval; what came twice would count twice.
    folder, rows, schema = shared_folder(spark, "flushed"), shared_folder(spark, "events"), "event_id long, event_type string"
    table(spark, d, "events").select("event_id", "event_type").write.parquet(rows)
    flushes = limits.flushed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(rows), lambda batch, number: X.append(batch, folder), shared_folder(spark, "flushes"))
    flushes.processAllAvailable()
    flushes.stop()
    return spark.read.schema(schema).parquet(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
