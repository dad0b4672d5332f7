"""The corpus operators against brute force, on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontaminate, jaccard_join, packing, phrase_dedup, quality_rules, suffix_dedup, token_files, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _words(rng, n):
    return [rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)]


def _texts():
    rng = random.Random(5)
    base = _words(rng, 260)
    passage = _words(rng, 60)
    out = [None, "", " \n\t ", "one", "one", "two words", " ".join(base), " ".join(base)]
    for k in range(30):  # near copies of one base, with more and more edits
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(9999)}"
        out.append(" ".join(own))
    for _ in range(12):
        own = _words(rng, rng.randrange(20, 200))
        at = rng.randrange(len(own))
        out.append("\n".join([" ".join(own[:at]), " ".join(passage[rng.randrange(10) :]), " ".join(own[at:])]))
    out += ["lä " * 900, "ab" * 400, " ".join(_words(rng, 9000)), "a   b \n c\td  ", "x <|endoftext|> y", " ".join(passage).upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, tie string")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def _ids(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids, 2], "<u4")


def test_token_files(spark, docs, texts):
    files = token_files.write(docs, common.shared_folder(spark, "t"), TOKENIZER, file_ids=3000)
    got = {r["doc_id"]: r for r in token_files.read(files, with_ids=True).collect()}
    start = 0
    for k in sorted(texts):
        ids = _ids(texts[k])
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"], bytes(got[k]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    assert len(got) == len(texts)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 70_000, n).astype("<u4")
    assert (token_files.unpack(*token_files.pack(ids), n) == ids).all()


def test_packing(docs, texts):
    rows = packing.pack(packing.pieces(docs, TOKENIZER)).toPandas()
    for k, own in rows.groupby("doc_id"):
        ids, own = _ids(texts[k]), own.sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for x in own.itertuples():
            assert zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    assert set(rows.doc_id) == set(texts)
    assert rows.sequence_id.nunique() <= max(-(-rows.length.sum() // 1024), (rows.length > 512).sum()) + 2
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 1024


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))}
    used = Counter()
    for lengths, times in packing.plan(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_few_sequences(seed):
    rng = random.Random(seed)
    counts = Counter(min(1024, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000))
    made = packing.plan(counts, 1024)
    least = max(-(-sum(k * n for k, n in counts.items()) // 1024), sum(n for k, n in counts.items() if k > 512))
    assert sum(times for _, times in made) <= 1.01 * least + 1
    exact = Counter(len(lengths) for lengths, _ in made if sum(lengths) == 1024)
    assert exact[2] and exact[3] and exact[4]  # single, pair and triple sums fill gaps


def test_sums_fill_gaps_of_real_lengths():
    """On the documents of sf0.1: pairs and triples of the index fill gaps, and one sequence more than the tokens need is made."""
    import pyarrow.parquet as pq

    from tidemark.llm.tokens import encoder

    counts = Counter()
    for batch in pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(500, columns=["text"]):
        counts.update(size for ids in encoder(TOKENIZER).encode(batch.column(0)) for _, size in packing.cuts(len(ids) // 4 + 1, 1024))
    assert sum(times for _, times in packing.plan(counts, 1024)) <= 9872
    left = np.zeros(1025, np.int64)
    left[list(counts)] = list(counts.values())
    left[1024] = 0
    before = left.copy()
    filled = packing.exact_fills(left, 1024)
    of_size = Counter()
    for lengths, times in filled:
        assert sum(lengths) == 1024
        of_size[len(lengths)] += times
        for x in lengths:
            before[x] -= times
    assert (before == left).all() and left.min() >= 0
    assert of_size[2] > 3_000 and of_size[3] > 500 and of_size[4] > 20


def test_ids_of_odd_texts_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import TextEncoder

    rng = random.Random(9)
    parts = ["a", "Hello", "it's", "l'été", "12", "x1", "ß", "日本", "Привет", "é", "𝒳", "😀", ".", "!?", "'", "-", "\u200b", "\x1c", "\u180e", "\U0001e030", "ǆ"]
    space = [" "] * 12 + ["\n", "\t", "\u00a0", "\r", "\u3000", "\x85", " \n", "\n\n", "  ", "\n\u00a0", ""]
    texts = ["a\n\u00a0", "Hello world.\n\u00a0", "a\n\u00a0\tb"]
    texts += ["".join(rng.choice(parts) + rng.choice(space) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    got = TextEncoder(TOKENIZER).encode(pa.array(texts, pa.large_string()))
    assert not [t for t, g, w in zip(texts, got, want, strict=True) if g != np.array(w.ids, "<u4").tobytes()]


def _components(texts):
    """(sets of shingles, smallest document of each one's group), by brute force."""
    sets = {}
    for k, t in texts.items():
        w = [x.encode().lower() for x in WORD.findall(t)]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def of(x):
        return x if root[x] == x else of(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = of(a), of(b)
                root[max(x, y)] = min(x, y)
    return sets, {k: of(k) for k in sets}


def test_jaccard(docs, texts):
    sets, root = _components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.group(docs).collect()}
    assert got == {k: (len(sets[k]), root[k]) for k in sets}
    stay = {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()}
    assert stay == {k for k in sets if root[k] == k}


@pytest.mark.parametrize(("n", "edits"), [(90, 6), (700, 25)])  # lists that are long in a task as well
def test_jaccard_long_lists_and_derived_links(spark, n, edits):
    rng = random.Random(11)
    base, rows = _words(rng, 120), []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    test_jaccard(df, dict(rows))


def test_jaccard_short_lists_with_an_unlike_centre(spark):
    rng = random.Random(1)
    a, b = ([f"w{rng.randrange(10**9)}" for _ in range(104)] for _ in range(2))
    mixed = [a[:52] + b[:52], a[52:] + b[52:]]  # the smallest ids of each list, a third like the others
    frequent = [x[48:56] for x in (a, b, *mixed)]  # shingles that come last in every order
    rows = [(k, " ".join(t)) for k, t in enumerate([*mixed, a, [*a, "more"], b, [*b, "more"], *frequent * 10])]
    test_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


def test_jaccard_of_sets_far_from_the_centre_but_near_each_other(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, ua, ub, b, d = fresh(16), fresh(11), fresh(11), fresh(114), fresh(121)
    frequent = [x[k : k + 9] for x in (ua, ub, b, d) for k in range(0, len(x), 4)] * 12
    rows = [(1, " ".join(p + d)), (10, " ".join(p + ua + b)), (11, " ".join(p + ub + b)), *((100 + k, " ".join(x)) for k, x in enumerate(frequent))]
    test_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_of_rare_passages_over_common_text(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)  # cells of a few sets
    monkeypatch.setattr(jaccard_join, "DIFFERENCE", 100)
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rare, common_parts, texts = [fresh(rng.randrange(8, 30)) for _ in range(3)], [fresh(60) for _ in range(5)], []
    for k in range(150):
        own = list(rng.choice(rare)) + [w for _ in range(rng.randrange(1, 4)) for w in rng.choice(common_parts)]
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(x[j : j + 8]) for x in common_parts for j in range(0, 52, 4)] * 3
    rows = list(enumerate(texts))
    test_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), dict(rows))


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, None, "<|im_end|>"), (5, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["text"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 4, 5} and got[1][:2] == (2, 2)
    assert got[1][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert "< |im_end|>" in got[5][2]


def test_tied_turns_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "bacde"] + [(1, None, None, "x"), (1, None, "", "y"), (2, 0, "", "x"), (3, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    for df in (turns, turns.orderBy(F.rand(1)).repartition(3)):
        got = sorted(tuple(r) for r in chat.format_chats(df).collect())
        assert got == sorted(con.execute(chat.SQL).fetchall()) and [r[0] for r in got] == [1, 2]  # 3 is how 1 begins
    assert got[0][3].startswith("<|im_start|>\nx<|im_end|>\n<|im_start|>\ny<|im_end|>")


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.com/en/x?q", "http://example.com/en/", "http://a.example.com/eng", "http://x.net/fr/1#f", "http://net/es/", "http://bexample.com/en/", "http://com", "http://x.com/", "a://b.com/en/://c"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, urls[4]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    con = duckdb.connect()
    pages_df = pages.toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT * FROM pages_df")
    want = con.execute(url_filter.SQL).df().sort_values("page_id").astype(str).values.tolist()
    for most in (100, 0):
        got = url_filter.judge(pages, rules, most_rules=most).toPandas().sort_values("page_id").astype(str)
        assert got.replace({"nan": "None"}).values.tolist() == [[x.replace("nan", "None") for x in r] for r in want]


def test_decontamination(spark, docs, texts):
    text = texts[40]
    words = decontaminate.words_of(text)
    items = spark.createDataFrame([(1, b" ".join(words[5:25]).upper().decode()), (2, "two, WORDS"), (3, None), (10, "!!")], "item_id long, text string")
    want = {}
    normal = {k: decontaminate.words_of(t) for k, t in texts.items()}
    for k, w in normal.items():
        hit, owners = set(), set()
        for item, t in ((1, b" ".join(words[5:25]).decode()), (2, "two words")):
            q = decontaminate.words_of(t)
            for i in range(max(1, len(q) - 9)):
                win = q[i : i + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        owners.add(str(item))
        want[k] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    for most in (10_000, 30, 12):  # one pass, several, and items in parts
        scanned = decontaminate.scan(docs, items, most_words=most)
        assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digests(scanned).collect()} == want
    row = decontaminate.scan(docs, items).where("row.doc_id = 5").first()
    assert [texts[5][a:b] for a, b in row["hit_spans"]] == ["two words"]


def test_items_in_parts_have_the_same_windows():
    words = [f"w{k % 7}" for k in range(53)]
    windows = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    for most in (10, 11, 25, 52, 53, 60):
        parts = [p.split() for p in decontaminate._parts(" ".join(words), 10, most)]
        assert all(len(p) <= most for p in parts) and set.union(*map(windows, parts)) == windows(words)


def test_scan_keeps_columns_of_any_name_and_items_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine"), (1, "a b c", "mine"), (2, "x", None)], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([(None, "b"), (7, "c"), (7, "a")], "item_id long, text string")
    scanned = decontaminate.scan(docs, items)
    assert scanned.select("row.*").dtypes == docs.dtypes and [r["n_words"] for r in scanned.where("row.doc_id = 1").select("row.n_words").collect()] == ["mine"] * 2
    got = [tuple(r)[:4] for r in decontaminate.digests(scanned).collect()]
    assert sorted(got) == [(1, 3, 3, 1), (1, 3, 3, 1), (2, 1, 0, 0)]
    con = duckdb.connect()
    documents, benchmark = docs.toPandas(), items.toPandas()  # noqa: F841
    want = [tuple(x)[:4] for x in con.execute(decontaminate.SQL).fetchall()]
    assert sorted(want) == sorted(got)


def test_warc(spark):
    big = "é" * 80
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "x" * 300), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(warc.with_origin(pages), common.shared_folder(spark, "w"), file_bytes=500)
    got = {r["page_id"]: r for r in warc.read(warc.normalise(files, common.shared_folder(spark, "n"))).collect()}
    assert {k: r["refers_to"] for k, r in got.items()} == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: None, 7: 1}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert got[k]["payload_bytes"] == len(raw) and got[k]["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert bytes(got[k]["payload"]) == (raw if got[k]["record_type"] == "response" else b"")


def _without_repeats(texts):
    """(text's bytes, which of them go) of each document, by brute force."""
    seen, out = set(), {}
    for k in sorted(texts):
        b = texts[k].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[k] = b, bytes(gone)
    return out


def _check_suffixes(docs, texts, **more):
    want = {}
    for k, (b, gone) in _without_repeats(texts).items():
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(docs, **more).collect()} == want


def test_suffixes(docs, texts):
    _check_suffixes(docs, texts)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and 7 not in {r["doc_id"] for r in left.collect()}


def test_suffixes_of_repeated_rows_that_share_a_gram(spark):
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = part(90)  # shorter than a window, so nothing repeats
    text, other = (part(150) + passage + part(150) for _ in range(2))
    rows = spark.createDataFrame([(1, text), (1, text), (2, other)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(rows).collect()) == [(1, 0), (1, 0), (2, 0)]


def test_suffixes_of_a_common_line(spark):
    """Many different contexts of one line: its group is split by keys."""
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = part(60)
    texts = {k: part(70) + line + part(70) for k in range(900)}
    for k in range(300):
        at = rng.randrange(20, 190)
        texts[k + 600] = texts[k][:at] + texts[k + 600][at:] if k % 2 else texts[k + 600][:at] + texts[k][at:]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert suffix_dedup.anchors.hot_grams(suffix_dedup.anchors.meet(docs, suffix_dedup.units_of, suffix_dedup.SHAPE, 50))
    _check_suffixes(docs, texts, hot=50)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_contexts(seed, monkeypatch):
    """Groups of any size, some at a time or all at once, against all pairs of windows."""
    rng = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "SORTED", rng.choice([300, 2000, 1 << 20]))
    contexts, keys, places = [], [], []
    for key in range(1, 5):
        base = bytes(rng.choice(b"ab") for _ in range(168))
        for k in range(rng.choice([1, 2, 5, 40])):
            own = bytearray(base)
            for _ in range(rng.randrange(3)):
                p = rng.choice([rng.randrange(68), rng.randrange(100, 168)])
                own[p] = rng.choice(b"abc")
            low, high = rng.choice([0, 0, rng.randrange(68)]), rng.choice([168, 168, rng.randrange(136, 168)])
            contexts.append(bytes(own[low:high]))
            keys.append(key)
            places.append((k // 2, 0, 1000 * (k % 2) + 68, 68 - low))
    order = list(range(len(keys)))
    rng.shuffle(order)
    own = [np.array([x[k] for k in order]) for x in (keys, places)]
    got = {(d, t): r for d, t, r in suffix_dedup._ranges(own[0].astype(np.uint64), own[1], np.array([len(contexts[k]) for k in order]), np.frombuffer(b"".join(contexts[k] for k in order), np.uint8))}
    want = {}
    for key in range(1, 5):
        seen, rows = set(), sorted((p, c) for p, c, g in zip(places, contexts, keys, strict=True) if g == key)
        for (d, t, at, before), c in rows:
            new = set()
            for s in range(len(c) - 99):
                if s <= before and s + 100 >= before + 32:
                    w = (c[s : s + 100], before - s)
                    if w in seen:
                        want.setdefault((d, t), set()).update(range(at - before + s, at - before + s + 100))
                    new.add(w)
            seen |= new
    assert {k: {b for x, y in np.frombuffer(r, "<i4").reshape(-1, 2).tolist() for b in range(x, y)} for k, r in got.items()} == want


@pytest.mark.parametrize("alphabet", [1000, 7])  # one letter a word, and two
def test_automata_in_shards(alphabet):
    rng = random.Random(2)
    lists = [[b"w%d" % rng.randrange(12) for _ in range(300)] for _ in range(5)]
    phrases = [(rng.randrange(5), a, a + rng.randrange(2, 9)) for a in range(0, 200, 5)]
    texts = [lists[d][a:b] for d, a, b in phrases]
    got = phrase_dedup.occurrences(lists, phrases, shard=20, alphabet=alphabet)
    for words, found in zip(lists, got, strict=True):
        assert set(map(tuple, found.tolist())) == {(k, k + len(p)) for p in texts for k in range(len(words)) if words[k : k + len(p)] == p}
    assert len(list(phrase_dedup.automata(["".join(map(chr, range(40, 47)))] * 12, shard=20))) == 4


def test_phrases_of_a_common_passage(spark):
    """Passages that share 20 words with many others, some of them more: the group is split by keys."""
    rng = random.Random(6)
    part = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = part(20)
    rows = {k: part(26) + line + part(26) for k in range(900)}
    for k in range(300):
        at = rng.randrange(20, 50)
        rows[k + 600] = rows[k][:at] + rows[k + 600][at:] if k % 2 else rows[k + 600][:at] + rows[k][at:]
    rows = {k: " ".join(w) for k, w in rows.items()}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    assert phrase_dedup.anchors.hot_grams(phrase_dedup.anchors.meet(docs, phrase_dedup.units_of, phrase_dedup.SHAPE, 50))
    _check_phrases(docs, rows, hot=50)


def test_phrases_of_a_passage_in_every_group(spark):
    """Many small groups, one licence text in each of them, and copies of documents in others."""
    rng = random.Random(12)
    licence = " ".join(_words(rng, 70))
    rows = [" ".join([*_words(rng, 40 + k % 7), licence if k % 3 else licence[: 40 * (k % 5)], *_words(rng, 30)]) for k in range(80)]
    rows += rows[:10] + [licence]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    for grouped in (1, 2_000):
        _check_phrases(docs, dict(enumerate(rows)), grouped=grouped)


def _check_phrases(docs, texts, **more):
    lists = {k: WORD.findall(t) for k, t in texts.items()}
    times = Counter(tuple(w[s : s + 35]) for w in lists.values() for s in range(len(w) - 34))
    want = {}
    for k, w in lists.items():
        gone = [0] * len(w)
        for s in range(len(w) - 34):
            if times[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [1] * 35
        want[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in phrase_dedup.dedup(docs, **more).collect()} == want


def test_phrases(docs, texts):
    _check_phrases(docs, texts)


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in texts] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels)).toPandas().set_index("doc_id")
    for k, t in texts.items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        triples = list(zip(w, w[1:], w[2:], strict=False))
        times = Counter(triples)
        repeat = len({p + j for p, x in enumerate(triples) if times[x] > 1 for j in range(3)})
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w))
        r = rows.loc[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)


def test_decision_list_rejects_what_its_rules_say(spark):
    """Labels that follow a rule: one is learned, and `kept` is its evaluation in plain Python."""
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(900):
        loud = k % 3 == 0
        words = _words(rng, rng.randrange(60, 90))
        rows.append((k, " ".join(w.upper() + "!!" if loud and rng.random() < 0.8 else w for w in words)))
        labels.append((k, 0 if loud else 1, 0))
    docs = spark.createDataFrame([*rows, *rows[:2]], "doc_id long, text string")
    rules = quality_rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules
    judged = quality_rules.judge(docs, rules).toPandas()
    assert len(judged) == 902
    for r in judged.itertuples():
        hit = any(all(getattr(r, f) <= cut if side == "<=" else getattr(r, f) >= cut for f, side, cut in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not hit)
    told = judged.set_index("doc_id").kept.groupby(level=0).first()
    assert sum(told[k] != bool(q) for k, q, _ in labels) < 20


def test_learning():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.9) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad, rng.random(3000) < 0.3)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality_rules._matches(rule, x, 3000)
    assert rules and (hit & ~bad).sum() <= 0.05 * hit.sum() and (hit & bad).sum() > 0.8 * bad.sum()


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for out in (token_files.read(token_files.write(none, common.shared_folder(spark, "e"), TOKENIZER)), packing.pack_documents(none), jaccard_join.group(none), suffix_dedup.dedup(none), phrase_dedup.dedup(none)):
        assert out.count() == 0
    text = " ".join(_words(random.Random(2), 80))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in suffix_dedup.dedup(some).collect())
    assert got == [("1", True), ("1", True), ("2", True), ("None", False), ("None", False)]  # the null id is the smallest
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard_join.group(some).collect() if r["n_shingles"])
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert jaccard_join.one_of_each(some).where("text is not null").count() == 1
    from tidemark.llm.tokens import encoder

    ids = {t: np.append(np.frombuffer(encoder(TOKENIZER).encode(pa.array([t], pa.string()))[0], "<u4"), np.uint32(2)).astype("<u4") for t in (text, None)}
    read = token_files.read(token_files.write(some, common.shared_folder(spark, "r"), TOKENIZER)).collect()
    want = Counter((k, len(ids[t]), zlib.crc32(ids[t].tobytes())) for k, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read) == want
    place = 0  # documents lie one after another by id, the null id first
    for r in sorted(read, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(read, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


CLASHING = ", ".join(f"{c} string" for c in "tie packed rest id n hi lo root copies kept n_words hit_ranges start length part place digest short found size origin chain words ranges kind data gram".split())


def _odd(spark, schema, rows):
    """A table with extra columns named as the operators' own ones, and with null rows."""
    n = len(CLASHING.split(", "))
    return spark.createDataFrame([(*r, *["extra"] * n) for r in rows], f"{schema}, {CLASHING}")


def test_odd_documents(spark):
    long = " ".join(_words(random.Random(3), 30_000))
    rows = [(1, "a b c " * 60), (1, "a b c " * 60), (2, None), (3, ""), (None, "x"), (None, None), (4, long)]
    docs = _odd(spark, "doc_id long, text string", rows)
    labels = spark.createDataFrame([(None, None, None), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, "x"), (7, None), (8, ""), (9, "A b")], "item_id long, text string")
    plain = docs.select("doc_id", "text")
    told = lambda df: Counter(map(str, df.collect()))
    for apply in (jaccard_join.group, suffix_dedup.dedup, phrase_dedup.dedup, lambda d: decontaminate.digests(decontaminate.scan(d, benchmark))):
        with_others = told(apply(docs))
        assert with_others == told(apply(plain)) and sum(with_others.values()) == len(rows)
    assert suffix_dedup.without_repeats(docs).columns == docs.columns
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert token_files.read(token_files.write(docs, common.shared_folder(spark, "o"), TOKENIZER)).count() == len(rows)
    packed = packing.pack_documents(docs)
    assert packed.where("piece = 0").count() == len(rows)
    judged = quality_rules.judge(docs.select(F.struct("*").alias("row"), "text"), quality_rules.fit(docs, labels))
    assert judged.select("row.*").columns == docs.columns and judged.where("kept").count() == 1
    found = decontaminate.digests(decontaminate.scan(docs, benchmark)).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == {1, None} and len(found) == len(rows)  # an item without id hits as well
    for none in (docs.limit(0), docs.where("doc_id < 0")):
        assert quality_rules.judge(none.select("doc_id", "text"), quality_rules.fit(none, labels.limit(0))).count() == 0
        assert decontaminate.scan(none, benchmark.limit(0)).count() == 0
    assert not [r for r in decontaminate.digests(decontaminate.scan(docs, benchmark.limit(0))).collect() if r["contaminated"]]


def test_odd_pages_and_turns(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = _odd(spark, "page_id long, url string, html string", [(1, None, None), (None, "http://example.com/en/x", "y" * 200), (2, "://", "y" * 200), (2, "://", "y" * 200), (3, "http://A.NET/es/" + "z" * 50_000, "")])
    verdicts = sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert verdicts == [("1", None, "allow"), ("2", None, "allow"), ("2", None, "allow"), ("3", "net/es/", "block"), ("None", "example.com/en/", "block")]
    assert [r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()] == ["allow"] * 5
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    index = warc.normalise(warc.write(warc.with_origin(pages), common.shared_folder(spark, "w")), common.shared_folder(spark, "n"))
    read = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect()]
    assert Counter(read) == Counter({(1, 0, "response", None): 1, (2, 200, "response", None): 2, (3, 0, "response", None): 1, (None, 200, "revisit", 2): 1})
    none = warc.write(warc.with_origin(pages.limit(0)), common.shared_folder(spark, "w"))
    assert warc.read(warc.normalise(none, common.shared_folder(spark, "n"))).count() == 0
    turns = _odd(spark, "conv_id long, turn long, role string, text string", [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, None, None), (3, 0, "user", "a"), (None, None, None, ""), (4, 0, "user", "w " * 100_000)])
    told = {r["conv_id"]: (r["n_turns"], r["n_equal"]) for r in chat.format_chats(turns).collect()}
    assert told == {2: (2, 1), None: (1, 1), 4: (1, 1)}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([*url_filter.RULES, ("a.b.c.d", "/", "block")], "host string, path string, verdict string")
    long = "x." * 100_000
    pages = spark.createDataFrame([(1, f"http://{long}net/fr/"), (2, f"http://{long}example.com/en/1"), (3, f"http://{long}b.c.d/"), (4, f"http://{long}a.b.c.d/"), (5, f"http://{long}/")], "page_id long, url string")
    verdicts = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect())
    assert verdicts == [(1, "net/fr/", "block"), (2, "example.com/en/", "block"), (3, None, "allow"), (4, "a.b.c.d/", "block"), (5, None, "allow")]


def test_target_uri_loses_line_ends_only():
    url = "http://x/\u2028a\x85b\x0bc\x0cd\x1ce\r\nf"
    head = warc.record(1, url, b"", "", None).split(b"\r\n\r\n")[0]
    assert warc.parse_head(head)["WARC-Target-URI"] == url.replace("\r\n", "")


def _kept(text, rules):
    """The base rules and the decision list, in plain Python."""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    triples = list(zip(w, w[1:], w[2:], strict=False))
    times = Counter(triples)
    repeat = len({p + j for p, x in enumerate(triples) if times[x] > 1 for j in range(3)})
    if len(w) < 50 or 100 * repeat > 50 * len(w):
        return False
    chars = sum(map(len, w))
    share = lambda characters: sum(c in characters for c in text) / chars
    x = dict(n_words=len(w), word_length=chars / len(w), symbol_share=share("#*$%&|<>"), dup_line_share=(len(lines) - len(set(lines))) / len(lines), repeat_share=repeat / len(w),
             capital_share=share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digit_share=share("0123456789"), mark_share=share("!?"), words_per_line=len(w) / len(lines))
    return not any(all(x[f] <= cut if side == "<=" else x[f] >= cut for f, side, cut in rule) for rule in rules)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """run() against the stages by brute force; rows that repeat, nulls, empty and long texts, columns of clashing names."""
    import corpus_pipeline

    rng = random.Random(21)
    loud = [" ".join(f"{w.upper()}!!" for w in _words(rng, 70)) for _ in range(120)]
    plain = [" ".join(_words(rng, 70 + k % 9)) for k in range(240)]
    texts = dict(enumerate([*_texts(), *loud, *plain]))
    passage = " ".join(WORD.findall(plain[3])[20:45])
    rows = [(k, t, "en", "s", len(t or ""), "mine", "row") for k, t in texts.items()]
    rows += [rows[6], rows[200], (None, None, None, None, None, None, None), (None, "", "", "", 0, "", "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    odd = len(_texts())
    labels = [(odd + k, 0, 0) for k in range(120)] + [(odd + 120 + k, 1, 0) for k in range(240)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage.upper()), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    rules = quality_rules.fit(docs, common.read(spark, str(tmp_path), "labels"))
    assert rules
    left = {k: t for k, t in texts.items() if t and _kept(t, rules)}
    assert 200 < len(left) < 330
    left = {k: left[k] for k, root in _components(left)[1].items() if k == root}
    cut = {}
    for k, (b, gone) in _without_repeats(left).items():
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept or not sum(gone):
            cut[k] = kept
    item = decontaminate.words_of(passage)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    left = {k: t for k, t in cut.items() if not any(tuple(w[i : i + 10]) in windows for w in [decontaminate.words_of(t)] for i in range(len(w) - 9))}
    assert len(left) < len(cut) < len(texts)
    want = {}
    for k, t in left.items():
        ids = _ids(t)
        for j, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
            want[k, j] = (start, length, zlib.crc32(ids[start : start + length].tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_on_a_corpus(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf), "stage")
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["doc_id"], r["piece"]): r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert {k for k, _ in got} == set(left)
    for k, t in left.items():
        ids = _ids(t)
        for j, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
            assert got[k, j]["ids_crc32"] == zlib.crc32(ids[start : start + length].tobytes())
