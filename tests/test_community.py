"""Literal cases of the operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import identity as I
from tidemark.functions import messages as M
from tidemark.functions import parameters as P
from tidemark.functions import scoring as S
from tidemark.operators import community as C
from tidemark.operators import folds as R
from tidemark.operators import writes as W
from tidemark.plans import FOUND
from tidemark.sources import files as X
from tidemark.streaming import limits


@pytest.mark.parametrize(("clicks", "states"), [([1], [1]), ([1, 1], [1, 0]), ([1, -1], [1, -1]), ([-1, -1], [-1, 0]), ([-1, 1], [-1, 1]), ([1, 1, 1, -1, -1, 1], [1, 0, 1, -1, 0, 1])])
def test_vote_toggle(spark, clicks, states):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(clicks)], "voter string, at int, value int")
    assert [r["state"] for r in C.fold_votes(rows, ["voter"], ["at"]).orderBy("at").collect()] == states


@pytest.mark.parametrize(("mean", "n", "expected"), [(3.0, 10, 10), (5.0, 40, 10), (4.1, 40, 9)])
def test_threshold(spark, mean, n, expected):
    assert spark.range(1).select(S.threshold(F.lit(mean), F.lit(n))).first()[0] == expected


@pytest.mark.parametrize(("text", "left"), [("<think>\nsecret\n</think>\n\nHello", "Hello"), ("<think>\nsecret\nHello", "secret\nHello"), ("Hello\n</think>", "Hello\n"), ("<think>reasoning</think>\n\n<final>Hello</final>", "Hello"), ("<final\nHello", "<final\nHello")])
def test_think_tags(spark, text, left):
    assert spark.range(1).select(S.strip_think(F.lit(text))).first()[0] == left


def test_sanitize(spark):
    html = '<a href="javascript:x()" onclick="y()">t</a><script>z()</script>'
    out = spark.range(1).select(S.sanitize(F.lit(html))).first()[0]
    assert "script" not in out and "onclick" not in out


def test_ranks(spark):
    """Ties across blocks of ids, negative points, and asked actors without points."""
    points = {k: k * 7 % 5 - 2 for k in range(40)}
    ledger = spark.createDataFrame([(k, p) for k, p in points.items()], "actor long, delta long")
    asked = [0, 3, 17, 39, 100, -5]
    own = {r["actor"]: (r["points"], r["rank"]) for r in C.rank_of(ledger, spark.createDataFrame([(a,) for a in asked], "actor long"), block=4).collect()}
    for a in asked:
        p = points.get(a, 0)
        assert own[a] == (p, 1 + sum(q > p or (q == p and b < a) for b, q in points.items()))


def test_calendar_limit(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 14, 59), 0), ("a", datetime(2024, 1, 1, 15, 0), 1), ("a", datetime(2024, 1, 1, 15, 1), 2), ("a", datetime(2024, 1, 1, 15, 2), 3)], "key string, ts timestamp_ntz, id int")
    out = C.calendar_limit(rows, ["key"], S.bucket_start("day", F.col("ts")), ["ts", "id"], 2)
    assert [r["admitted"] for r in out.orderBy("id").collect()] == [True, True, True, False]


def test_thread(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "e"), ("f", "g"), ("g", "f"), ("h", "g")], "id string, parent string")
    got = {(r["id"], r["root"], r["depth"]) for r in C.thread_paths(rows, "id", "parent").collect()}
    assert got == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)}


def test_deep_thread(spark):
    rows = spark.range(200).select("id", (F.col("id") - 1).alias("parent"))
    assert sorted(map(tuple, C.thread_paths(rows, "id", "parent").collect())) == [(k, 0, k, list(range(1, k + 1))) for k in range(200)]


def _stream(spark, tmp_path, rows, make, mode="append"):
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    return spark.table(name)


def _minutes(spark):
    return spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m), 10 * k + m) for k in range(2) for m in range(0, 50, 7)], "key string, ts timestamp, event_id int")


def test_distinct_stream(spark, tmp_path):
    rows = _minutes(spark)
    assert _stream(spark, tmp_path, rows, lambda s: limits.distinct_events(s, ["key", "ts"], "ts", "1 hour")).count() == rows.select("key", "ts").distinct().count()


def test_points_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, 1 if k % 4 else -1) for k in range(40)], "actor int, delta long")
    own = _stream(spark, tmp_path, rows, limits.running_points, "complete")
    assert sorted(own.collect()) == sorted(rows.groupBy("actor").agg(F.sum("delta").alias("points")).collect())


def test_tool_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, None), ("b", 4, "y"), ("b", 5, "z")], "call string, seq int, output string")
    own = _stream(spark, tmp_path, rows, lambda s: limits.tool_calls(s, "call", "output", "seq"), "complete")
    assert sorted(map(tuple, own.collect())) == [("a", "x", 2), ("b", "z", 5)]


def _minute(m):
    return datetime(2024, 1, 1, 0, m)


RULES = [
    (R.window_limit(2, 600), ["ts"], [(_minute(m),) for m in (0, 1, 9, 10, 11, 12)], [(True, 1, 0), (True, 0, 0), (False, 0, 60), (True, 1, 0), (True, 0, 0), (False, 0, 480)]),
    (R.cooldown(60), ["ts"], [(_minute(0),), (_minute(0),), (_minute(2),)], [(True, 0), (False, 60), (True, 0)]),
    (R.failure_lock(2, 300), ["ts", "flag"], [(_minute(0), True), (_minute(1), True), (_minute(3), False), (_minute(6), True), (_minute(12), False)], [("failed", 1, 0), ("locking", 2, 300), ("locked", 2, 180), ("locking", 3, 300), ("ok", 0, 0)]),
    (R.reservation(1, 600), ["ts", "flag"], [(_minute(0), False), (_minute(5), False), (_minute(10), False), (_minute(11), True), (_minute(30), False)], [("reserved", 0), ("held", 0), ("reserved", 0), ("bound", 1), ("limit", 1)]),
]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_rules(spark, tmp_path, k):
    """Batch and stream give a rule's literal results."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rule, values, given, expected = RULES[k]
    schema = "key string, id int, ts timestamp" + ", flag boolean" * ("flag" in values)
    rows = spark.createDataFrame([(key, i, *g) for key in (None, "a", "b") for i, g in enumerate(given)], schema)
    names = [c.split()[0] for c in rule[0].split(", ")]
    told = lambda df, key: [tuple(r[n] for n in names) for r in df.where(F.col("key").eqNullSafe(key)).orderBy("id").collect()]
    batch = R.fold(rows, "key", ["ts", "id"], values, rule)
    assert all(told(batch, F.lit(key)) == expected for key in (None, "a", "b"))
    rows = rows.coalesce(1).where("key is not null")
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    q = limits.fold(stream, "key", ["ts", "id"], values, rule).writeStream.format("memory").queryName(f"rule{k}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert all(told(spark.table(f"rule{k}"), F.lit(key)) == expected for key in ("a", "b"))


def test_challenge_and_growing_text():
    end, step = _minute(5), R.challenge(2)[1]
    state, told = None, []
    for m, given in ((0, ""), (1, "x"), (2, "x"), (3, "y"), (6, "y"), (7, "y")):
        state, out = step(state, _minute(m), end, given, "y")
        told.append(out[0])
    assert told == ["required", "invalid", "invalid", "locked", "expired", "not_found"]
    state, shown = None, []
    for text in ("a", "abc", None, "ab", "abd"):
        state, out = R.growing_text()[1](state, text)
        shown.append(out[0])
    assert shown == ["a", "abc", "abc", "abc", "abd"]


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 3)], "key string, seq int")
    out = R.fold(rows, "key", ["seq"], ["seq"], R.sequence_gaps())
    assert sorted((r["key"], r["seq"]) for r in out.where("expected is not null").collect()) == [("a", 5)]
    assert R.fold(rows.limit(0), "key", ["seq"], ["seq"], R.sequence_gaps()).count() == 0


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "shown", "key", "error"), [("  AbC   \ud14c\uc2a4\ud2b8  ", "AbC \ud14c\uc2a4\ud2b8", "abc \ud14c\uc2a4\ud2b8", None), ("\uad00\ub9ac\uc790", "\uad00\ub9ac\uc790", "\uad00\ub9ac\uc790", "NICK_RESERVED"), ("\u3147\u3147", "\u110b\u110b", "\u110b\u110b", None), ("\u200bx", "x", "x", "NICK_INVALID"), (None, None, None, "NICK_REQUIRED"), ("\uff21\uff22", "AB", "ab", None)])
def test_nicknames(spark, raw, shown, key, error):
    row = spark.createDataFrame([(raw,)], "n string").select(I.nickname(F.col("n")), I.nickname_key(F.col("n")), I.nickname_error(I.nickname_key(F.col("n")))).first()
    assert tuple(row) == (shown, key, error)


def test_unsafe(spark):
    assert _value(spark, S.unsafe(F.lit("\uc528\ubc1c \uc8fd\uc5ec"), M.unsafe_rules())) == ["hate_or_slur", "threats"]


@pytest.mark.parametrize(("text", "left"), [("[Signal +1] hi", "hi"), ("[2024-01-02T03:04Z] hi", "hi"), ("[other] hi", "[other] hi"), ("hi", "hi"), (None, None)])
def test_envelope(spark, text, left):
    assert _value(spark, M.strip_envelope(F.lit(text).cast("string"))) == left


def test_message_parts(spark):
    items = F.from_json(F.lit('[{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}, {"type": "thinking", "thinking": " t "}]'), M.ITEMS)
    none = F.lit(None).cast("string")
    assert _value(spark, M.raw_text(none, items, F.lit("f"))) == "a\nb"
    assert _value(spark, M.thinking(none, items, none)) == "t"
    assert _value(spark, M.message_role(none, none, none, items)) == "unknown"
    assert _value(spark, M.message_role(F.lit("user"), F.lit("1"), none, items)) == "toolResult"
    assert [_value(spark, M.role_group(F.lit(r))) for r in ("Tool_Result", "User", "function")] == ["tool", "User", "tool"]


@pytest.mark.parametrize(("name", "allow", "deny", "ok"), [("read", [], [], True), ("read", ["*"], ["re*"], False), ("apply_patch", ["exec"], [], True), ("Apply_Patch ", ["exec"], ["apply*"], False), ("a.b", ["a.*"], [], True), ("axb", ["a.*"], [], False)])
def test_policy(spark, name, allow, deny, ok):
    assert _value(spark, M.allowed(F.lit(name), allow, deny)) is ok


def test_display_texts(spark):
    assert [_value(spark, M.byte_size(F.lit(n).cast("long"))) for n in (None, 5, 2304, 20 * 1024, 3 * 2**30)] == ["-", "5 B", "2.3 KB", "20 KB", "3.0 GB"]
    assert [_value(spark, M.duration_text(F.lit(n).cast("long"))) for n in (None, 5, 90_000, 3 * 3_600_000, 72 * 3_600_000)] == ["n/a", "5ms", "2m", "3h", "3d"]
    assert _value(spark, M.number_or(F.lit("x"), 3)) == 3.0
    assert _value(spark, M.parse_list(F.lit(" a, b\n,c "))) == ["a", "b", "c"]


def test_documents(spark):
    row = spark.createDataFrame([('{"a": {"b": 1, "c": [1]}}', '{"a": {"b": 2, "c": [1]}, "d": null}')], "x string, y string")
    out = row.select(D.diff(F.col("x"), F.col("y")).alias("d"), D.set_path(F.col("x"), ["a", "b"], 5).alias("s"), D.remove_path(F.col("x"), ["a", "c"]).alias("r"), D.diff(F.lit("no"), F.col("y")).alias("n")).first()
    assert [tuple(d) for d in out["d"]] == [("a.b", "1", "2"), ("d", None, "null")]
    assert (out["s"], out["r"], out["n"]) == ('{"a":{"b":5,"c":[1]}}', '{"a":{"b":1}}', [])


def test_zero_bits(spark):
    assert [_value(spark, I.leading_zero_bits(F.lit("07ff"), n)) for n in (0, 4, 5, 6)] == [True, True, True, False]


def test_signature_query(spark):
    import hashlib
    import hmac

    sf = "/root/testdata/sf0.001"
    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    for r in FOUND["f26_signature"][0](spark, sf).collect():
        want = hmac.new(b"secret", names.pop(r["c_custkey"]).encode(), hashlib.sha256).hexdigest()
        assert (r["signature"], r["ok"]) == (want, int(want[0], 16) < 2)
    assert not names


def test_confiscation(spark):
    ledger = spark.createDataFrame([("a", 10), ("b", 3), ("c", -3), ("d", 5)], "target string, delta int")
    targets = spark.createDataFrame([(t, 1) for t in "abcde"], "target string, author int")
    out = W.confiscate_once(ledger, targets, targets.where("target = 'd'"))
    assert sorted((r["target"], r["taken"]) for r in out.collect()) == [("a", 10), ("b", 3), ("c", 0), ("e", 0)]


def test_thread_trees(spark):
    """Forward references, branches, missing and unmarked parents, a comment that answers itself."""
    rows = [(1, "root"), (2, ">>1 a"), (3, ">>5  b"), (4, ">>1\tc"), (5, ">>2d"), (6, ">>99 gone"), (7, ">> no marker"), (8, ">>8 self"), (9, " >>1 not first"), (10, ">>2 e"), (11, ">>x y")]
    comments = spark.createDataFrame(rows, "id long, body string")
    edges = {r["id"]: r["parent"] for r in C.reply_edges(comments).collect()}
    assert edges == {1: None, 2: 1, 3: 5, 4: 1, 5: None, 6: None, 7: None, 8: 8, 9: None, 10: 2, 11: None}
    told = {r["id"]: (r["root"], r["depth"], r["path"], r["place"]) for r in C.thread_order(C.thread_paths(C.reply_edges(comments), "id", "parent"), "id").collect()}
    assert {k: v for k, v in told.items() if v[0] == 1} == {1: (1, 0, [], 1), 2: (1, 1, [2], 2), 10: (1, 2, [2, 10], 3), 4: (1, 1, [4], 4)}
    assert told[3] == (5, 1, [3], 2) and 8 not in told
    assert {5, 6, 7, 9, 11} == {k for k, v in told.items() if v[1] == 0} - {1}


@pytest.mark.parametrize(("body", "parent", "rest"), [(">>abc-1_  hi", "abc-1_", "hi"), ("hi >>abc", None, "hi >>abc"), (">>", None, ">>"), (">>a\n\nb", "a", "b")])
def test_reply_marker(spark, body, parent, rest):
    assert tuple(spark.range(1).select(S.reply_parent(F.lit(body)), S.reply_body(F.lit(body))).first()) == (parent, rest)


def test_gaps_across_blocks(spark):
    rows = [("a", k) for k in (1, 2, 5, 6, 31, 32)] + [("b", 7), ("b", 9)]
    found = C.gaps(spark.createDataFrame(rows, "key string, seq long"), "key", "seq", block=5)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 3, 5), ("a", 7, 31), ("b", 8, 9)]


def test_first_reached_across_blocks(spark):
    rows = [("a", k, m) for k, m in enumerate([1, -1, 1, 1, 0, 1, -1])] + [("b", 0, 2)]
    moves = spark.createDataFrame(rows, "key string, at long, move int")
    found = C.first_reached(moves, "key", ["at"], "move", 3, F.floor(F.col("at") / 2))
    assert [tuple(r) for r in found.collect()] == [("a", 5)]


_STATE = "version string, cursor long, tags array<string>"


@pytest.mark.parametrize(("text", "state"), [(None, ("0", 7, None)), ("{ broken", ("0", 7, None)), ('{"cursor": 9, "tags": ["x"]}', ("0", 9, ["x"])), ('{"cursor": null, "other": 1}', ("0", None, None)), ('{"cursor": "no number"}', ("0", 7, None))])
def test_state_with_defaults(spark, tmp_path, text, state):
    if text is not None:
        (tmp_path / "state.json").write_text(text)
    read = lambda **more: tuple(X.load_state(spark, f"{tmp_path}/state.json", _STATE, {"version": "0", "cursor": 7}, **more).first())
    assert read() == state and read(fixed={"version": "9"})[0] == "9"


@pytest.mark.parametrize(
    ("text", "body", "found"),
    [
        ("---\na: 1\nb:\n  c: 'x y' # note\n  d:\n    - e: 2\n      f: 3\n    - e: 4\ntags:\n  - u\n  - v\nz: \"q\"\n---\n\n body --- more", "body --- more", [("a", "1"), ("b.c", "x y"), ("b.d.e", "2"), ("b.d.f", "3"), ("b.d.e", "4"), ("tags", "u"), ("tags", "v"), ("z", "q")]),
        ("no matter", "no matter", []), ("---\nopen", "---\nopen", []), ("", "", []), ("--- ---", "", []),
    ],
)
def test_front_matter(spark, text, body, found):
    parts = spark.createDataFrame([(text,)], "text string").select(D.front_matter(F.col("text")).alias("p"))
    row = parts.select("p.body", D.settings(F.col("p.matter")).alias("s"), D.setting(D.settings(F.col("p.matter")), "b.c", "none").alias("c")).first()
    assert (row["body"], [tuple(x) for x in row["s"]], row["c"]) == (body, found, dict(found).get("b.c", "none"))


def test_log_tail(spark):
    lines = spark.createDataFrame([(k, "x" * k) for k in range(1, 11)], "seq long, line string")
    tail = lambda *a: [tuple(r) for r in X.log_tail(lines, *a).select("seq", "cut").orderBy("seq").collect()]
    assert tail(None, 3, 1000) == [(8, True), (9, True), (10, True)]
    assert tail(7, 5, 1000) == [(8, False), (9, False), (10, False)]
    assert tail(7, 5, 21) == [(9, True), (10, True)]
    assert tail(10, 5, 1000) == []


@pytest.mark.parametrize(("value", "expected"), [("20", 20), ("999", 50), ("0", 30), ("-3", 30), ("7px", 7), ("x", 30), (None, 30), ("", 30), (" 12", 12)])
def test_page_limit(spark, value, expected):
    assert spark.range(1).select(P.limit(F.lit(value).cast("string"))).first()[0] == expected


@pytest.mark.parametrize(("text", "error"), [(None, None), ("", None), (" a ", "SHORT"), ("ab", None), ("x" * 120, None), ("x" * 121, "LONG")])
def test_query_error(spark, text, error):
    assert spark.range(1).select(P.query_error(F.lit(text).cast("string"))).first()[0] == error


def test_allowed_and_routed(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = lambda v: F.lit(v).cast("string")
    assert [one(P.allowed(s(v), P.SORTS, "new")) for v in ("hot", "HOT", None, "")] == ["hot", "new", "new", "new"]
    cases = [("tool", "main", "r", "c", "r", True), ("tool", None, "r", "c", "r", True), ("tool", "other", "r", "c", "r", False), ("tool", "main", "q", "c", "r", False),
             ("tool", "main", "r", "", "r", False), ("chat", "main", "r", "c", "r", False), ("tool", None, None, "c", None, False), ("tool", "main", "r", "c", None, False)]
    for stream, session, run, call, own, expected in cases:
        assert one(P.routed(s(stream), s(session), s(run), s(call), s("main"), s(own))) == expected


def test_increment_batch_and_stream(spark, tmp_path):
    totals, new = (spark.createDataFrame(rows, "actor long, points long") for rows in ([(1, 5), (2, -1)], [(2, 4), (3, 1)]))
    assert sorted(tuple(r) for r in W.increment(totals, new, "actor", "points").collect()) == [(1, 5), (2, 3), (3, 1)]
    for name, rows in (("a", [(1, 5), (2, -1)]), ("b", [(2, 4), (3, 1)])):
        spark.createDataFrame(rows, "actor long, delta long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("actor long, delta long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = limits.running_points(stream).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("sums").collect()) == [(1, 5), (2, 3), (3, 1)]


def test_flushes_at_an_interval(spark, tmp_path):
    """What comes between two flushes is given at once."""
    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/in")
    given: list[int] = []
    query = limits.flushed(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda batch, number: given.append(batch.count()), f"{tmp_path}/c")
    query.processAllAvailable()
    query.stop()
    assert sum(given) == 20 and len([n for n in given if n]) == 1
