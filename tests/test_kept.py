"""Indexes, tables in place, kept ranks and threads, bucketed joins and pages: rows by brute force, and what is read and written."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import parameters as P
from tidemark.operators import community as C
from tidemark.operators import kept_threads as K
from tidemark.operators import postings, ranking
from tidemark.plans import kept
from tidemark.sources import buckets as B
from tidemark.sources import files as X
from tidemark.sources import layout as L

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W]+")


def _files(folder):
    """path -> (size, time) of the data files below a folder."""
    return {os.path.join(at, n): (os.stat(os.path.join(at, n)).st_size, os.stat(os.path.join(at, n)).st_mtime_ns) for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scanned(df):
    """Files that each scan of a query reads, by running it."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plan.append(node.plan())
        elif kind == "FileSourceScanExec":
            out.append(node.metrics().apply("numFiles").value())
        else:
            plan += [node.children().apply(k) for k in range(node.children().size())]
    return out


TEXTS = {3: "The sea, the SEA", 70: "a sea of Trees_1", -5: "trees", 71: None, 72: "", 140: "sea trees the", 9_000_000_000: "the straße sea"}


@pytest.fixture
def words(spark, tmp_path):
    index = postings.Index(f"{tmp_path}/words", buckets=8, block=64)
    rows = spark.createDataFrame([*TEXTS.items(), (None, "the sea")], "id long, body string")
    postings.add(index, rows, "id", postings.words(F.col("body")))
    return index


@pytest.mark.parametrize(("terms", "found"), [(["sea"], [3, 70, 140, 9_000_000_000]), (["sea", "the"], [3, 140, 9_000_000_000]), (["trees"], [-5, 140]), (["trees_1", "a", "of"], [70]), (["sea", "none"], []), ([], []), (["straße"], [9_000_000_000])])
def test_index_finds(spark, words, terms, found):
    assert sorted(r["id"] for r in postings.search(spark, words, terms).collect()) == found


def test_index_reads_the_asked_partitions_only(spark, words):
    asked = postings.asked(spark, words, ["sea"])
    assert _scanned(asked)[0] < len(_files(f"{words.folder}/postings")) / 2
    assert "PartitionFilters: [isnotnull(bucket" in _plan(asked) or "PartitionFilters: [(bucket" in _plan(asked) or "PartitionFilters: [bucket" in _plan(asked)
    assert "EqualTo(term,sea)" in _plan(asked) or "In(term, [sea])" in _plan(asked)


def test_index_codes_ids_as_differences(words):
    import pyarrow.parquet as pq

    column = [c for f in _files(f"{words.folder}/postings") for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in map(g.column, range(g.num_columns)) if c.path_in_schema.startswith("ids")]
    assert column and all("DELTA_BINARY_PACKED" in c.encodings for c in column)


def test_index_takes_changed_rows(spark, words):
    new = spark.createDataFrame([(3, "dunes"), (70, "sea again"), (500, "sea")], "id long, body string")
    postings.add(words, new, "id", postings.words(F.col("body")), replaces=True)
    ids = lambda *terms: sorted(r["id"] for r in postings.search(spark, words, list(terms)).collect())
    assert ids("sea") == [70, 140, 500, 9_000_000_000] and ids("dunes") == [3] and ids("again", "sea") == [70] and ids("trees_1") == []


@pytest.mark.parametrize(("pattern", "runs"), [("%the_on%", ["the", "on"]), (r"a\%b%c", ["a%b", "c"]), ("%", []), ("ÄB_", ["äb"])])
def test_fixed_parts(pattern, runs):
    assert postings.fixed_parts(pattern) == runs


@pytest.mark.parametrize("pattern", ["%sea%", "%SEA_tr%", "%s_a%", "%", "the%sea", "%trees\\_1", "%none%", "%aße s%"])
def test_trigram_search(spark, tmp_path, pattern):
    rng = random.Random(1)
    texts = TEXTS | {1_000 + k: "".join(rng.choice("sea thre") for _ in range(30)) for k in range(200)}
    rows = spark.createDataFrame(list(texts.items()), "id long, body string").withColumn("term", F.lit(1))
    index = postings.Index(f"{tmp_path}/grams", buckets=8, block=64)
    postings.add(index, rows, "id", postings.trigrams(F.col("body")))
    postings.lay_out(rows, "id", f"{tmp_path}/rows", 64)
    found = postings.ilike(spark, index, f"{tmp_path}/rows", "id", "body", pattern, 64)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.where(F.col("body").ilike(pattern)).collect())


def test_candidates_limit_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(1_000)], "id long, body string")
    postings.lay_out(rows, "id", f"{tmp_path}/rows", 64)
    found = postings.of_ids(spark, f"{tmp_path}/rows", "id", spark.createDataFrame([(5,), (70,)], "id long"), 64)
    assert sorted(r["id"] for r in found.collect()) == [5, 70]
    assert 2 in _scanned(found) and len(_files(f"{tmp_path}/rows")) == 16


# Tables in place


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    table = B.Table(f"{tmp_path}/t", "k", width=10)
    B.create(table, spark.createDataFrame([(k, k % 3, "x") for k in range(100)], "k long, v long, w string"))
    before = _files(table.folder)
    assert B.upsert(spark, table, spark.createDataFrame([(7, 70, "y"), (203, 1, "z"), (5, None, None)], "k long, v long, w string")) == [0, 20]
    after = _files(table.folder)
    same = {f: s for f, s in before.items() if "bucket=0/" not in f}
    assert same.items() <= after.items() and not {f for f in before if "bucket=0/" in f} & after.keys()
    want = {k: (k % 3, "x") for k in range(100)} | {7: (70, "y"), 203: (1, "z"), 5: (None, None)}
    assert {r["k"]: (r["v"], r["w"]) for r in B.read(spark, table).collect()} == want
    assert [tuple(r) for r in B.of_keys(spark, table, [7]).collect()] == [(7, 70, "y")] and _scanned(B.of_keys(spark, table, [7])) == [1]


def test_update_and_increment_in_place(spark, tmp_path):
    table = B.Table(f"{tmp_path}/t", "k", buckets=16)
    B.create(table, spark.createDataFrame([(f"k{k}", k) for k in range(200)], "k string, v long"))
    before = _files(table.folder)
    assert B.update_where(spark, table, F.col("v") == 5, {"v": F.lit(-1)}) == 1
    assert len(before.keys() - _files(table.folder).keys()) == 1
    assert B.update_where(spark, table, F.col("v") > 10_000, {"v": F.lit(0)}) == 0
    B.add_to(spark, table, spark.createDataFrame([("k1", 10), ("k1", 5), ("new", 3)], "k string, v long"), "v")
    want = {f"k{k}": k for k in range(200)} | {"k5": -1, "k1": 16, "new": 3}
    assert {r["k"]: r["v"] for r in B.read(spark, table).collect()} == want


# Ranks and threads


@pytest.mark.parametrize("widths", [(4, 2), (65_536, 1_024)])
def test_kept_ranks(spark, tmp_path, widths):
    rng = random.Random(3)
    ranks = ranking.Ranks(f"{tmp_path}/r", *widths)
    ranking.create(spark, ranks)
    rows = []
    for _ in range(3):
        batch = [(rng.randrange(-5, 25), rng.choice([-3, -1, 1, 2])) for _ in range(25)] + [(None, 4)]
        ranking.apply(spark, ranks, spark.createDataFrame(batch, "actor long, delta long"))
        rows += batch
    points = {a: sum(d for b, d in rows if b == a) for a, _ in rows if a is not None}
    rank = lambda a: 1 + sum((-p, b) < (-points.get(a, 0), a) for b, p in points.items())
    assert {r["actor"]: (r["points"], r["rank"]) for r in ranking.all_ranks(spark, ranks).collect()} == {a: (p, rank(a)) for a, p in points.items()}
    for a in (-5, 3, 24, 99):
        assert ranking.rank(spark, ranks, a) == (points.get(a, 0), rank(a))
    assert ranking.groups_above(spark, ranks, 0) == sum(p > 0 for p in points.values())


def test_ranks_of_a_batch_touch_few_blocks(spark, tmp_path):
    ranks = ranking.Ranks(f"{tmp_path}/r", 10, 1_024)
    ranking.create(spark, ranks)
    ranking.apply(spark, ranks, spark.createDataFrame([(k, 1) for k in range(100)], "actor long, delta long"))
    before = _files(ranks.actors.folder)
    ranking.apply(spark, ranks, spark.createDataFrame([(15, 1)], "actor long, delta long"))
    assert {re.search(r"bucket=([^/]+)", f)[1] for f in before.keys() - _files(ranks.actors.folder).keys()} == {"1"}


def _forest_rows():
    rng = random.Random(8)
    rows = [(k, f">>{rng.randrange(k)} reply" if k and rng.random() < 0.9 else "top") for k in range(60)]
    rows += [(100, ">>101 late"), (101, ">>102 later"), (102, ">>3 latest"), (200, ">>999 gone"), (201, ">>200 under"), (300, ">>301 loop"), (301, ">>302 loop"), (302, ">>300 loop"), (303, ">>302 hangs on"), (400, ">>400 self"), (401, ">>400 under self")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_threads_in_any_order(spark, tmp_path, seed):
    rows = _forest_rows()
    whole = spark.createDataFrame(rows, "id long, body string")
    want = {tuple(map(str, r)) for r in C.thread_paths(C.reply_edges(whole), "id", "parent").select("id", "root", "depth", "path").collect()}
    random.Random(seed).shuffle(rows)
    forest = K.Forest(f"{tmp_path}/f", 8)
    K.create(spark, forest)
    for low in range(0, len(rows), 25):
        before = _files(forest.nodes.folder)
        K.add(spark, forest, spark.createDataFrame(rows[low : low + 25], "id long, body string"))
        assert before.items() <= _files(forest.nodes.folder).items()  # nothing is rewritten
    assert {tuple(map(str, r)) for r in K.paths(spark, forest).collect()} == want


# Layouts


def test_bucketed_join_has_no_exchange(spark):
    rows = kept.bucketed_authors(spark, SF)
    rows.collect()
    plan = _plan(rows)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and "SelectedBucketsCount: 16 out of 16" in plan


def test_pages_cover_the_table_once_and_read_their_range(spark, tmp_path):
    keys = random.Random(2).sample(range(10_000), 1_003)
    keyset = L.Keyset(f"{tmp_path}/k", "id")
    L.lay_out(keyset, spark.createDataFrame([(k, f"v{k}") for k in keys] + [(None, "x")], "id long, v string").repartition(5), 20)
    read = [[r["id"] for r in page.orderBy("id").collect()] for page, _ in L.pages(spark, keyset, 100)]
    assert [k for page in read for k in page] == sorted(keys) and [len(p) for p in read] == [100] * 10 + [3]
    assert 1 <= _scanned(L.page_after(spark, keyset, sorted(keys)[499], 100))[0] <= 5
    assert L.page_after(spark, keyset, max(keys), 100) is None


def test_pages_go_on_after_a_failure(spark, tmp_path):
    keyset, seen = L.Keyset(f"{tmp_path}/k", "id"), []
    L.lay_out(keyset, spark.range(250), 5)

    def work(page):
        ids = sorted(r["id"] for r in page.collect())
        if ids[0] == 100 and not seen.count("failed"):
            seen.append("failed")
            raise RuntimeError("lost")
        seen.extend(ids)

    with pytest.raises(RuntimeError):
        L.each_page(spark, keyset, 50, work, f"{tmp_path}/cursor")
    assert L.each_page(spark, keyset, 50, work, f"{tmp_path}/cursor") == 3
    assert [s for s in seen if s != "failed"] == list(range(250))
    assert L.each_page(spark, keyset, 50, work, f"{tmp_path}/cursor") == 0
    empty = L.Keyset(f"{tmp_path}/e", "id")
    L.lay_out(empty, spark.range(0), 5)
    assert list(L.pages(spark, empty, 50)) == []


# Smaller rules


@pytest.mark.parametrize(("value", "expected"), [("9" * 20, 50), ("-" + "9" * 20, 30), ("000000000000000000000012", 12), ("　 7", 7), ("+5x", 5), ("0", 30)])
def test_long_limits(spark, value, expected):
    assert spark.range(1).select(P.limit(F.lit(value))).first()[0] == expected


@pytest.mark.parametrize(("text", "error"), [("　a　", "SHORT"), ("﻿ab ", None), ("\U0001f600", None), ("x" * 121 + " ", "LONG")])
def test_search_texts_with_wide_spaces(spark, text, error):
    assert spark.range(1).select(P.query_error(F.lit(text))).first()[0] == error


def test_board_entries(spark):
    matter = "targets:\n  boards:\n    - slug: a\n      per_loop_read_limit: 5\n    - slug: b\n      tags:\n        - x\n        - y\n    - perLoopReadLimit: 3\nquotas:\n  boards:\n    - slug: no\n"
    found = spark.createDataFrame([(matter,), (None,)], "m string").select(D.entries(F.col("m"), "targets.boards").alias("e")).collect()
    assert [[tuple(x) for x in e] for e in found[0]["e"]] == [[("slug", "a"), ("per_loop_read_limit", "5")], [("slug", "b"), ("tags", "x"), ("tags", "y")], [("perLoopReadLimit", "3")]]
    assert found[1]["e"] == []


def test_audit_failures_stay_unseen(spark, tmp_path):
    rows = spark.createDataFrame([("HUMAN", "1", "/x", "GET", 200, "1.2.3.4", None, 5), ("AGENT", None, "/y", "POST", 500, "", "ua", None)], "actor_type string, actor_id string, endpoint string, method string, status int, ip string, user_agent string, latency_ms int")
    assert X.log_audit(rows, f"{tmp_path}/audit", "p") and X.log_audit(rows, f"{tmp_path}/audit", "p")
    assert not X.log_audit(rows, "nowhere://x/audit", "p")
    told = spark.read.parquet(f"{tmp_path}/audit").collect()
    assert len(told) == 4 and {r["ip"] is None for r in told} == {True, False} and all(r["ip"] is None or len(r["ip"]) == 64 for r in told)
