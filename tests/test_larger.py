"""Queries against their SQL on values that the small test tables don't have."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrase_dedup
from tidemark.operators import community as C
from tidemark.operators import postings
from tidemark.plans import FOUND
from tidemark.sources import layout as L

SF = "/root/testdata/sf0.001"


def differences(spark, name, folder):
    """(rows of the SQL that the query lacks, rows of the query that the SQL lacks)."""
    query, sql = FOUND[name]
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    con.execute(f"CREATE TABLE other AS {sql}")
    columns = ", ".join(f'"{c[0]}"' for c in con.execute("DESCRIBE other").fetchall())
    own = query(spark, str(folder)).toPandas()  # noqa: F841 (DuckDB reads it)
    con.execute(f"CREATE TABLE own AS SELECT {columns} FROM own")
    return con.execute("FROM other EXCEPT ALL FROM own").fetchall(), con.execute("FROM own EXCEPT ALL FROM other").fetchall()


def put(folder, name, sql):
    duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_sizes_of_ten_megabytes_and_more(spark, tmp_path):
    put(tmp_path, "part", f"SELECT * REPLACE (p_partkey * 997 + 100_000 AS p_partkey) FROM '{SF}/part.parquet' UNION ALL SELECT * REPLACE (p_partkey * 30_000_001 AS p_partkey) FROM '{SF}/part.parquet'")
    assert differences(spark, "f37_formats", tmp_path) == ([], [])


@pytest.mark.parametrize("start", ["2024-01-17 11:59:58", "2024-01-17 11:58:59", "1969-12-31 23:59:59", "2310-05-05 05:05:05"])
def test_ages_within_a_millisecond(spark, tmp_path, start):
    put(tmp_path, "events", f"SELECT k AS event_id, TIMESTAMP '{start}' + to_microseconds(k * 499 + k % 3) AS ts, k AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM (SELECT unnest(range(8_000)) AS k)")
    assert differences(spark, "f36_ages", tmp_path) == ([], [])


def test_runs_of_pages_go_on_after_a_failure(spark, tmp_path):
    keyset, told, calls = L.Keyset(f"{tmp_path}/k", "id"), {}, []
    L.lay_out(keyset, spark.range(1_003).select((F.col("id") * 7919 % 100_003 - 50_000).alias("id")), 7)
    want = sorted(k * 7919 % 100_003 - 50_000 for k in range(1_003))

    def work(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        for r in rows.groupBy("page").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect():
            assert told.setdefault(r["page"], r["ids"]) is r["ids"]

    with pytest.raises(RuntimeError):
        L.each_run(spark, keyset, 50, work, f"{tmp_path}/cursor", 8)
    assert L.each_run(spark, keyset, 50, work, f"{tmp_path}/cursor", 8) == 2 and len(calls) == 4
    assert [told[k] for k in range(21)] == [want[k : k + 50] for k in range(0, 1_003, 50)]
    assert L.each_run(spark, keyset, 50, work, f"{tmp_path}/cursor", 8) == 0


def test_pages_take_few_jobs(spark, tmp_path):
    put(tmp_path, "orders", f"SELECT * REPLACE (o_orderkey * 1_000 + k AS o_orderkey) FROM '{SF}/orders.parquet', (SELECT unnest(range(100)) AS k)")
    spark.sparkContext.setJobGroup("pages", "")
    assert differences(spark, "o10_keyset_pages", tmp_path) == ([], [])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pages")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pages_of_an_empty_table(spark, tmp_path):
    put(tmp_path, "orders", f"FROM '{SF}/orders.parquet' LIMIT 0")
    assert differences(spark, "o10_keyset_pages", tmp_path) == ([], [])


def test_threads_write_open_rows_only(spark, monkeypatch):
    written = []

    def settled(df):
        df = df.cache()
        written.append(df.count())
        return df

    monkeypatch.setattr(C, "settled", settled)
    rows = spark.createDataFrame([(k, None if k % 10 == 0 else k - 1) for k in range(100)] + [(200, 201), (201, 200), (202, 201)], "id long, parent long")
    assert C.thread_paths(rows, "id", "parent").count() == 100
    # A thread has a row of each depth from 0 to 9. The cycle and the row that hangs on it stay: a round that finishes none is the last.
    assert written == [103, 93, 83, 63, 23, 3]


def test_trigrams_have_no_row_each(spark, tmp_path, monkeypatch):
    texts = {0: "abcabc", 1: "ABCd", -70: "xy\U0001f600z", 65: "İabc", 66: None, 67: "ab", 68: "abcd abcd"}
    monkeypatch.setattr(postings, "HELD", 5)
    monkeypatch.setattr(postings, "LISTED", 2)
    index = postings.Index(f"{tmp_path}/grams", buckets=4, block=64)
    rows = spark.createDataFrame([*texts.items(), (0, "abc!"), (None, "abc")], "id long, body string").repartition(2)
    postings.add(index, rows, "id", postings.trigrams(F.col("body")))
    found = {}
    for r in spark.read.parquet(f"{index.folder}/postings").collect():
        assert r["ids"] == sorted(set(r["ids"])) and r["n"] == len(r["ids"])
        assert found.setdefault((r["term"], r["block"]), r["ids"]) is r["ids"]
    lower = {id_: [t for (t,) in spark.createDataFrame([(x or "",)], "t string").select(F.lower("t")).collect()] for id_, x in texts.items()}
    lower[0].append("abc!")
    want = {}
    for id_, own in lower.items():
        for gram in {t[k : k + 3] for t in own for k in range(len(t) - 2)}:
            want.setdefault((gram, id_ // 64), []).append(id_ % 64)
    assert found == {k: sorted(v) for k, v in want.items()}


def test_phrases_that_others_cover_are_not_compiled():
    row = [(0, k, k + 62) for k in range(0, 1_400, 14)]
    few = phrase_dedup.needed(row, [False] * len(row))
    assert sum(b - a for _, a, b in few) < 2 * 1_448 and {w for _, a, b in few for w in range(a, b)} == set(range(1_448))
    assert phrase_dedup.needed(row, [True] * len(row)) == row
    rng = random.Random(4)
    for _ in range(300):
        phrases = [(rng.randrange(2), a, a + rng.randrange(35, 63)) for a in (rng.randrange(200) for _ in range(rng.randrange(12)))]
        several = [rng.random() < 0.2 for _ in phrases]
        kept = phrase_dedup.needed(phrases, several)
        cover = lambda x: {(d, w) for d, a, b in x for w in range(a, b)}
        assert cover(kept) == cover(phrases) and set(kept) <= set(phrases) and {p for p, s in zip(phrases, several, strict=True) if s} <= set(kept)
