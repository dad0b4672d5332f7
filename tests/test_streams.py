"""Streams with expiring and bounded state, and the log source, against their batch forms."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds as R
from tidemark.sources import log_stream
from tidemark.streaming import limits, queues

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _streamed(spark, folder, batches, schema):
    """A stream of one file a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for name in os.listdir(f"{folder}/in"):
            if name.startswith("part-"):
                os.utime(f"{folder}/in/{name}", (k + 1, k + 1)) if os.stat(f"{folder}/in/{name}").st_mtime > 1_000 else None
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _run(stream, folder, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return stream.sparkSession.table(name)


def _state(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/c").count()


REQUEST = "user string, id string, ts timestamp, ends timestamp, removes boolean, seq long"


def test_approvals_expire_with_the_watermark(spark, tmp_path):
    rng = random.Random(4)
    rows = [("u%d" % rng.randrange(3), "r%d" % rng.randrange(6), at(k), at(k + rng.choice([5, 20, 60])), rng.random() < 0.15, k) for k in range(120)]
    batches = [rows[k : k + 30] for k in range(0, 120, 30)]
    last = [("end", "none", at(10_000), at(10_001), True, 1_000)]
    told = _run(queues.expiring(_streamed(spark, tmp_path, [*batches, last, last], REQUEST).withWatermark("ts", "0 seconds"), "user", "id", "ends", "removes", "seq"), tmp_path, "approvals").collect()
    # By entry: an expiry follows each last word that wasn't a removal, and nothing is left.
    events = {}
    for r in told:
        events.setdefault((r["user"], r["id"]), []).append((r["at"], r["change"]))
    words = {(u, i, s): (e, gone) for u, i, _, e, gone, s in rows}
    for (user, id_), changes in events.items():
        added = [s for s, c in changes if c in ("added", "replaced")]
        for s, c in changes:
            if c == "expired":  # the entry's last word before it ended
                assert s in added and not any(a > s and words[user, id_, a][0] and a in added and at(a) < words[user, id_, s][0] for a in added)
        assert sum(c == "added" for _, c in changes) == sum(c in ("removed", "expired") for _, c in changes)
    assert _state(spark, tmp_path, "entries") == 0


def test_approvals_that_live_equal_the_batch_form(spark, tmp_path):
    rows = [("a", "x", at(0), at(10), False, 0), ("a", "y", at(1), at(90), False, 1), ("b", "x", at(2), at(80), False, 2), ("a", "x", at(3), at(70), False, 3), ("b", "z", at(4), at(30), False, 4), ("b", "x", at(40), None, True, 5), ("c", "q", at(60), at(100), False, 6)]
    ticks = [("-", "-", at(65), None, True, 7)], [("-", "-", at(65), None, True, 8)]
    told = _run(queues.expiring(_streamed(spark, tmp_path, [rows[:3], rows[3:5], rows[5:], *ticks], REQUEST).withWatermark("ts", "0 seconds"), "user", "id", "ends", "removes", "seq"), tmp_path, "living").collect()
    state = {}
    for r in told:
        state.setdefault((r["user"], r["id"]), []).append(r["change"])
    assert state[("a", "x")] == ["added", "replaced"] and state[("b", "z")] == ["added", "expired"] and state[("b", "x")] == ["added", "removed"]
    # The batch form: the last word of each entry that isn't a removal and ends after now.
    batch = spark.createDataFrame(rows, REQUEST).groupBy("user", "id").agg(F.max_by(F.struct("ends", "removes"), "seq").alias("r")).where((F.col("r.ends") > F.lit(at(65))) & ~F.col("r.removes"))
    left = {k for k, changes in state.items() if changes[-1] in ("added", "replaced")}
    assert left == {(r["user"], r["id"]) for r in batch.collect()} and _state(spark, tmp_path, "entries") == len(left)


FOLDS = [(R.window_limit(2, 600), R.window_ends), (R.cooldown(300), R.cooldown_ends(300)), (R.cached(600), R.cooldown_ends(600))]


@pytest.mark.parametrize("k", range(len(FOLDS)))
def test_folds_forget_what_is_over(spark, tmp_path, k):
    rule, ends = FOLDS[k]
    rng = random.Random(k)
    rows = sorted((at(rng.randrange(600)), rng.choice("abc"), n) for n in range(150))
    rows = [(key, n, ts) for n, (ts, key, _) in enumerate(rows)]
    schema = "key string, id int, ts timestamp"
    batches = [rows[i : i + 50] for i in range(0, 150, 50)] + [[("z", 1_000 + n, at(5_000 * (n + 1)))] for n in range(3)]
    names = [c.split()[0] for c in rule[0].split(", ")]
    told = _run(limits.fold(_streamed(spark, tmp_path, batches, schema).withWatermark("ts", "0 seconds"), "key", ["ts", "id"], ["ts"], rule, ends), tmp_path, f"ends{k}").where("key <> 'z'")
    batch = R.fold(spark.createDataFrame(rows, schema), "key", ["ts", "id"], ["ts"], rule)
    put = lambda df: sorted(tuple(r) for r in df.select("id", *names).collect())
    assert put(told) == put(batch)
    assert _state(spark, tmp_path, "state") <= 1  # of the last event's key alone


def test_a_reservation_that_bound_stays(spark):
    assert R.reservation_ends((0, at(5))) == at(5) and R.reservation_ends((1, at(5))) is None


@pytest.mark.parametrize("moves", [True, False])
def test_rings_keep_the_newest(spark, tmp_path, moves):
    rng = random.Random(9)
    rows = [("s%d" % rng.randrange(3), "c%d" % rng.randrange(9), rng.choice([None, "out%d" % k]), k) for k in range(200)]
    schema = "session string, call string, output string, seq long"
    told = _run(queues.ring(_streamed(spark, tmp_path, [rows[k : k + 40] for k in range(0, 200, 40)], schema), "session", "call", "output", "seq", 4, moves), tmp_path, f"ring{moves}")
    told = told.orderBy("session", "step", "place").collect()
    assert max(r["place"] for r in told) == 4 and _state(spark, tmp_path, "entries") == 12
    last = {r["session"]: r["step"] for r in told}
    now = [r for r in told if r["step"] == last[r["session"]]]
    want = {}
    for session, call, output, _ in rows:
        held = want.setdefault(session, {})
        old = held.pop(call, None) if moves else held.get(call)
        held[call] = output or old
        if len(held) > 4:
            del held[next(iter(held))]
    assert [(r["session"], r["call"], r["output"]) for r in now] == [(s, c, o) for s in sorted(want) for c, o in want[s].items()]
    # The batch form tells the same evictions.
    batch = R.fold(spark.createDataFrame(rows, schema), "session", ["seq"], ["call"], R.ring(4, moves))
    assert batch.groupBy("session").agg(F.max_by("kept", "seq").alias("kept")).where("kept <> 4").count() == 0


def _lines(query_rows):
    return sorted((os.path.basename(r["file"]), r["at"], r["line"]) for r in query_rows)


def test_log_source(spark, tmp_path):
    log_stream.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("".join(f"a{k}\n" for k in range(10)) + "open")
    (logs / "b.log").write_bytes(b"b0\r\n\xff\n" + b"x" * 3_000_000 + b"\n")
    (logs / "c.txt").write_text("not asked\n")
    sizes = []

    def read(out, **options):
        stream = spark.readStream.format("log_tail").option("path", f"{logs}/*.log").options(**options).load()

        def keep(batch, n):
            rows = batch.collect()
            sizes.append(len(rows))
            out.extend(rows)

        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        query.stop()
        assert query.exception() is None
        return out

    first = _lines(read([], maxLines=4))
    assert first == [*(("a.log", 3 * k, f"a{k}") for k in range(10)), ("b.log", 0, "b0"), ("b.log", 4, "�"), ("b.log", 6, "x" * 3_000_000)]
    assert max(sizes) <= 4
    # A restart goes on where it stopped: the open line has ended, a file is new, another one was truncated.
    with (logs / "a.log").open("a") as f:
        f.write("ed\n")
    (logs / "b.log").write_text("new b\n")
    (logs / "d.log").write_text("d0\nd1\n")
    assert _lines(read([], maxLines=4)) == [("a.log", 30, "opened"), ("b.log", 0, "new b"), ("d.log", 0, "d0"), ("d.log", 3, "d1")]
    (logs / "a.log").unlink()
    with (logs / "d.log").open("a") as f:
        f.write("d2\n")
    assert _lines(read([])) == [("d.log", 6, "d2")]


def test_log_source_limits_bytes(tmp_path):
    (tmp_path / "x.log").write_text("".join(f"{'y' * 9}\n" for _ in range(10)))
    reader = log_stream.LogReader({"path": str(tmp_path), "maxBytes": "35"})
    steps = [reader.latestOffset()[str(tmp_path / "x.log")][0] for _ in range(5)]
    assert steps == [30, 60, 90, 100, 100]
    assert log_stream.LogReader({"path": str(tmp_path), "maxBytes": "3"}).latestOffset() == {str(tmp_path / "x.log"): [10, 0]}
    assert log_stream.LogReader({"path": str(tmp_path / "none")}).latestOffset() == {}
