"""Prefix trie, nearest neighbours and importance resampling against brute force, odd tables included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, neighbours, prefix_trie

CONVERSATION = "conv_id long, turn long, role string, text string"


def _turns():
    rng = random.Random(11)
    rows = []
    for c in range(90):
        if c % 13 == 0:
            continue  # some first ones of five are absent
        start = rng.choice([[], ["a"], ["a", "b"], ["a", "b", "c", "d", "e", "f", "g", "h", "i"]])
        texts = start + [rng.choice(["x", "ü", "", None, "long " * 50]) for _ in range(rng.choice([0, 1, 2, 5, 12, 40]))]
        rows += [(c, k, "user" if k % 2 else None, t) for k, t in enumerate(texts)]
    rows += [(300, None, "user", "null turn"), (300, 1, "b", "tie"), (300, 1, "a", "tie"), (300, 1, "a", "tie"), (-7, 1, "user", "a"), (None, 1, "user", "a")]
    return rows + [(400 + k, n, "user", t) for k in range(30) for n, t in enumerate("abcdefgh")]  # copies


def _brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1].encode()) if n else 0)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie(spark, block):
    rows = _turns()
    turns = spark.createDataFrame(rows, CONVERSATION).withColumns({"depth": F.lit(1), "node": F.lit("x"), "conv": F.lit(3)}).repartition(3)
    own = prefix_trie.prefix_trie(turns, block=block).select(*TRIE).collect()
    assert sorted(str(tuple(r)) for r in own) == _brute_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATION)).count() == 0
    # 7 % 5 leaves 5, which is absent, so what precedes the conversation's own later turns is nothing.
    c = next(c for c in range(6, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 1, "user", "text")]
    own = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATION)).select(*TRIE).collect()
    assert sorted(str(tuple(r)) for r in own) == _brute_trie(rows)
    assert [(r["depth"], r["n_leaves"]) for r in own] == [(0, 1)]


# Nearest neighbours


def _exact(ids, x, queries, most):
    scores = x[queries] @ x.T
    for k, q in enumerate(queries):
        others = np.flatnonzero(ids != ids[q])
        yield ids[q], others[np.lexsort((ids[others], -scores[k, others]))][:most], scores[k]


def _recall(found, ids, x, most):
    place, hits, total = {i: k for k, i in enumerate(ids)}, 0, 0
    queries = np.flatnonzero(ids % neighbours.EVERY == 0)
    assert set(found["query_id"]) == set(ids[queries])
    for query, top, scores in _exact(ids, x, queries, most):
        own = found[found["query_id"] == query].sort_values("rank")
        at = [place[i] for i in own["vec_id"]]
        assert list(own["rank"]) == list(range(1, len(top) + 1))
        assert np.allclose(own["score"], scores[at], rtol=1e-12)
        assert [tuple(r) for r in own[["score", "vec_id"]].to_numpy()] == sorted((tuple(r) for r in own[["score", "vec_id"]].to_numpy()), key=lambda r: (-r[0], r[1]))
        hits, total = hits + len(set(at) & set(top)), total + len(top)
    return hits / total


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 24))
    if kind == "clusters":
        x = rng.standard_normal((12, 24))[rng.integers(0, 12, 4000)] + 0.2 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 1, (4000, 1))
    x, ids = x.astype(np.float32).astype(float), rng.permutation(9000)[:4000]
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    found = neighbours.nearest(vectors, F.col("vec_id") % neighbours.EVERY == 0, per_list=60).toPandas()
    assert _recall(found, ids, x, neighbours.MOST) >= 0.9


def test_graph_finds_nearly_what_a_scan_finds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5000, 16)).astype(np.float32)
    graph = neighbours.Graph(neighbours.halved(x, 256))
    apart = np.sqrt(((x[:400, None] - graph.centroids[None]) ** 2).sum(2))
    want = apart <= 1.16 * apart.min(1, keepdims=True)
    rows, cells, far = graph.search(x[:400], 1.16)
    got = np.zeros(want.shape, bool)
    got[rows, cells] = True
    assert (got & want).sum() >= 0.98 * want.sum()
    assert np.allclose(far, apart[rows, cells], atol=1e-3)
    assert len(neighbours.halved(x, 256)) == 256


def test_equal_vectors_odd_vectors_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 0.0]) for k in range(0, 400, 2)]  # most rows are one vector
    rows += [(1001 + k, rng.standard_normal(3).tolist()) for k in range(300)]
    rows += [(2000, [0.5, 0.5]), (2001, [0.5, 0.5, 0.0]), (2020, [3.0]), (2020, [3.0]), (2040, [9.0, 9.0, 9.0]), (2040, [1.0, 1.0, 1.0])]
    odd = [(3000, None), (3020, [0.0, 0.0]), (3040, [1.0, None]), (3060, [nan, 1.0]), (3080, [inf]), (3100, []), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cls": F.lit(1), "query": F.lit("x"), "ids": F.lit(2), "score": F.lit(3)})
    found = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, per_list=30, block=40, probe=99.0).toPandas()
    held = {}
    for i, v in rows:
        held[i] = min(held.get(i, v), v)
    ids = np.array(sorted(held))
    x = np.array([held[i] + [0.0] * (3 - len(held[i])) for i in ids])
    # All lists are read, so nothing may be missed, ties included.
    place = {i: k for k, i in enumerate(ids)}
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(found["query_id"]) == set(ids[queries])
    for q in queries:
        scores = neighbours.in_order(np.repeat(x[q : q + 1], len(x), 0), x)
        want = sorted((-scores[k], i) for i, k in place.items() if i != ids[q])[:20]
        own = found[found["query_id"] == ids[q]].sort_values("rank")
        assert [(-s, i) for s, i in zip(own["score"], own["vec_id"], strict=True)] == want


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0]), (2, [-1.0])], kind)
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1, 2.0), (20, 2, 2, -1.0)]


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENT = "doc_id long, text string"


def _features(text, longest, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def _brute_resample(docs, target, percent, least, longest, buckets, seed):
    s, t = (Counter(b for text in texts for b in _features(text, longest, buckets)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n_words, found = _features(text, longest, buckets)
        weight = sum(gain[b] for b in found) // max(1, len(found))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(str(tuple(r)) for r in rows)


def _documents():
    rng = random.Random(2)
    words = ["Alpha", "beta", "ümlaut", "x" * 70, "42", "漢字", "a_b", "it's"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(150)]
    docs += [(None, "alpha " * 30), (None, "alpha " * 30), (500, None), (501, ""), (502, "..."), (503, "beta " * 20_000)]
    return docs + [(900, "beta 42 " * 15)] * 80 + [(900, "beta 42 " * 16)] * 40  # one row many times


@pytest.mark.parametrize(("percent", "longest", "buckets"), [(10, 1, 10_000), (37, 2, 50), (100, 3, 1), (0, 1, 10)])
def test_resample(spark, percent, longest, buckets):
    docs, target = _documents(), ["beta 42 gamma", None, "alpha's", "beta"]
    rows = spark.createDataFrame(docs, DOCUMENT).withColumns({"score": F.lit("x"), "row": F.lit(1), "id": F.lit(2), "may": F.lit(False)}).repartition(3)
    own = importance.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), percent, 20, longest, buckets).collect()
    assert sorted(str(tuple(r)) for r in own) == _brute_resample(docs, target, percent, 20, longest, buckets, importance.SEED)


def test_resample_empty_tables(spark):
    texts = spark.createDataFrame([("alpha",)], "text string")
    assert importance.resample(spark.createDataFrame([], DOCUMENT), texts).count() == 0
    docs = _documents()
    own = importance.resample(spark.createDataFrame(docs, DOCUMENT), texts.limit(0), 50).collect()
    assert sorted(str(tuple(r)) for r in own) == _brute_resample(docs, [], 50, 20, 1, importance.BUCKETS, importance.SEED)


def test_checksums_of_words_at_text_ends():
    texts = ["ab", "cd", None, "", "ef gh", "é", "Z" * 100, " x"]
    for longest in (1, 2, 3):
        found, rows, n_words = importance.features(pa.array(texts), longest, 1 << 30)
        assert n_words.tolist() == [_features(t, 1, 1)[0] for t in texts]
        assert sorted(zip(rows.tolist(), found.tolist(), strict=True)) == sorted((k, b) for k, t in enumerate(texts) for b in _features(t, longest, 1 << 30)[1])


@pytest.mark.parametrize("wanted", [0, 1, 499, 500, 501, 777, 1000])
def test_cutoff_counts_exactly(spark, wanted):
    rng = random.Random(wanted)
    rows = [(rng.choice([-5, 0, 0, 0, 10**12]), rng.choice([7, 7, -(2**63)]), 1, k * 3) for k in range(1000)]
    table = spark.createDataFrame(rows, "down long, id long, n_features long, row long")
    assert sorted(map(tuple, table.where(importance.cutoff(table, wanted)).collect())) == sorted(rows)[:wanted]
