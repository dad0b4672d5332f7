"""Substring dedup: remove every word that lies in a passage of 35 words which occurs more than once in the corpus.

1. `anchors` finds the places whose neighbourhood can recur. Documents are put in groups of about 1 MB, and each group lists its
   different passages there (up to 62 words), once each.
2. `_confirm` brings equal and similar passages together and compares them word by word. What occurs at two
   places or more is a confirmed phrase: a whole passage, or a run of its windows. It holds each passage, not who has it: groups
   ask for a passage's phrases by its digest, in a join that Spark splits where very many groups have one passage.
3. A group's confirmed phrases are compiled into Aho-Corasick automata with a letter per word, in shards of `SHARD` words. All
   documents of the group are streamed through them; the words removed are those that the automata find, wherever
   and however often they occur. Passages overlap, so a phrase whose words others of its document cover isn't compiled, unless the group has
   its passage at several places; each other place of it has a passage with phrases of its own. A group is a shard of the corpus: its automata need no phrase that its documents don't have.

Words are runs of bytes other than \\x20 and \\x09-\\x0D, unchanged. Null text has none. Rows that share doc_id and text are one
document, and its words don't recur by that. An empty table gives an empty result. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import anchors, common

WINDOW, GRAM = 35, 8
SHAPE = anchors.Shape(WINDOW, GRAM)
#: Bytes of text in a group of documents, of passages that a task collects, and of passages that are compared at once.
GROUPED, COLLECTED, COMPARED = 1 << 20, 24 << 20, 4 << 20
#: Words of the phrases in one automaton (some 40 MB), and letters that strings can hold.
SHARD, LETTERS = 1_000_000, 1_112_000
DIGEST = 16
PASSAGE = np.dtype([("key", "<u8"), ("doc", "<u4"), ("low", "<u4"), ("high", "<u4"), ("several", "?")])


def units_of():
    hashes = common.WordHashes()

    def units(column: pa.Array):
        lists = [x.as_buffer().to_pybytes().split() for x in column.cast(pa.large_string()).cast(pa.large_binary())]
        starts = np.cumsum([0] + [len(x) for x in lists])
        return hashes.of([w for x in lists for w in x]), starts

    return units


def _groups(texts: DataFrame, hot: frozenset[int], grouped: int) -> DataFrame:
    """Documents in groups, each with its different passages and their digests, from texts(doc_id, tie, packed, points). A written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        first, made = TaskContext.get().partitionId() << 32, 0
        docs, seen, rows, size = [], {}, [], 0

        def give() -> pa.RecordBatch:
            raw = packer.compress(pickle.dumps((docs, np.array(rows, PASSAGE)), 5))
            asked = b"".join([xxh3_128_digest(context, key) for key, context in seen])  # in the order of rows
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([raw], pa.binary()), pa.array([asked], pa.binary())], names=["group", "packed", "asked"])

        for batch in batches:
            for doc_id, tie, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "packed", "points")), strict=True):
                text = opener.decompress(packed)
                words = text.split() if own else []
                points = np.unique(np.frombuffer(b"".join(own or []), anchors.POINT))
                for key, at, before, context in anchors.read_contexts(words, points, SHAPE, hot, b" ".join):
                    known = seen.get((key, context))
                    if known is None:
                        seen[key, context] = len(rows)
                        rows.append((key, len(docs), at - before, min(len(words), at + WINDOW), False))
                    else:
                        k, d, low, high, _ = rows[known]
                        first_place = (*(docs[d][:2] if d < len(docs) else (doc_id, tie)), low)
                        if first_place != (doc_id, tie, at - before):
                            rows[known] = (k, d, low, high, True)
                docs.append((doc_id, tie, text))
                size += len(text) + 50
                if size >= grouped:
                    yield give()
                    docs, seen, rows, size, made = [], {}, [], 0, made + 1
        if docs:
            yield give()

    return common.settle(common.in_arrow(texts, work, "group long, packed binary, asked binary"), "groups")


def _asks(groups: DataFrame) -> DataFrame:
    """group, passage (its place in the group) and id (its digest) of all passages of all groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, asked in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = len(asked.as_buffer()) // DIGEST
                ids = pa.Array.from_buffers(pa.binary(DIGEST), n, [None, asked.as_buffer()]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group)), pa.array(np.arange(n, dtype=np.int32)), ids], names=["group", "passage", "id"])

    return common.in_arrow(groups.select("group", "asked"), work, "group long, passage int, id binary")


def _passages(groups: DataFrame) -> DataFrame:
    """The groups' passages dealt by key; a task sends equal ones once."""
    buckets = 4 * common.tasks(groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        seen: dict[tuple[int, bytes], int] = {}
        places, several, size = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter((k for k, _ in seen), np.uint64, len(seen))
            contexts = [c for _, c in seen]
            where = np.array(places, np.int64).reshape(-1, 3)
            rows = []
            for b, own in anchors.parts((keys % np.uint64(buckets)).astype(np.int64), buckets):
                raw = (keys[own], where[own], np.array(several, bool)[own], [contexts[k] for k in own.tolist()])
                rows.append((b, packer.compress(pickle.dumps(raw, 5))))
            yield from anchors.packed_rows(rows)

        for batch in batches:
            for packed in batch.column(0):
                docs, passages = pickle.loads(opener.decompress(packed.as_buffer()))
                words, own = [], None
                for key, d, low, high, twice in passages.tolist():
                    if d != own:
                        words, own = docs[d][2].split(), d
                    context = b" ".join(words[low:high])
                    place = (docs[d][0], docs[d][1], low)
                    n = seen.setdefault((key, context), len(places))
                    if n == len(places):
                        places.append(place)
                        several.append(twice)
                        size += len(context) + 300
                    elif twice or places[n] != place:
                        several[n] = True
                if size >= COLLECTED:
                    yield from send()
                    seen.clear()
                    places, several, size = [], [], 0
        if seen:
            yield from send()

    return common.in_arrow(groups.select("packed"), work, "bucket int, packed binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, phrases) of the passages that hold confirmed phrases: int32 pairs (first word, end word)."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    for bucket in anchors.by_bucket(batches):
        # Equal passages of all tasks are one.
        seen: dict[tuple[int, bytes], int] = {}
        places, several = [], []
        for packed in bucket:
            keys, where, twice, contexts = pickle.loads(opener.decompress(packed))
            for key, place, again, context in zip(keys.tolist(), where.tolist(), twice.tolist(), contexts, strict=True):
                n = seen.setdefault((key, context), len(places))
                if n == len(places):
                    places.append(place)
                    several.append(again)
                elif again or places[n] != place:
                    several[n] = True
        phrases = _phrases(seen, np.array(places, np.int64).reshape(-1, 3), np.array(several, bool))
        phrases = phrases[np.argsort(phrases[:, 0], kind="stable")]
        pairs, edges = phrases[:, 1:].astype("<i4"), [*np.flatnonzero(~anchors.same_as_before(phrases[:, 0])).tolist(), len(phrases)]
        passages, flat = list(seen), pairs.tobytes()
        numbers, edges = phrases[edges[:-1], 0].tolist(), (8 * np.array(edges)).astype(np.int32)
        for at in range(0, len(numbers), 50_000):
            ids = [xxh3_128_digest(context, key) for key, context in (passages[n] for n in numbers[at : at + 50_000])]
            own = edges[at : at + len(ids) + 1]
            told = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((own - own[0]).tobytes()), pa.py_buffer(flat[own[0] : own[-1]])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), told], names=["id", "phrases"])


def _phrases(seen: dict[tuple[int, bytes], int], places: np.ndarray, several: np.ndarray) -> np.ndarray:
    """(passage, first word, end word) rows: whole passages with several places, and runs of recurring windows of others."""
    contexts = [c for _, c in seen]
    found = [np.array([(n, 0, contexts[n].count(b" ") + 1) for n in np.flatnonzero(several).tolist()], np.int64).reshape(-1, 3)]
    keys = np.fromiter((k for k, _ in seen), np.uint64, len(seen))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(~anchors.same_as_before(keys[order]))
    sizes = np.diff(np.append(first, len(order)))
    mixed = (sizes > 1) & (np.add.reduceat(~several[order], first) > 0) if len(first) else np.zeros(0, bool)
    rows = order[np.repeat(mixed, sizes)]
    total = np.append(0, np.cumsum([len(contexts[k]) for k in rows.tolist()]))
    edges = np.append(0, np.cumsum(sizes[mixed]))
    k = 0
    while k < len(edges) - 1:
        to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + COMPARED, "right")) - 1)
        own = rows[edges[k] : edges[to]]
        group = np.repeat(np.arange(to - k), np.diff(edges[k : to + 1]))
        found.append(_runs([contexts[n].split(b" ") for n in own.tolist()], group, places[own], several[own], own))
        k = to
    return np.concatenate(found)


def _runs(lists: list[list[bytes]], group, places, several, numbers) -> np.ndarray:
    """(number, first word, end word) of the runs of windows that occur at two places at least of a group of passages."""
    letters: dict[bytes, int] = {}
    units = np.array([letters.setdefault(w, len(letters)) for x in lists for w in x], np.int64)
    lengths = np.array([len(x) for x in lists])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    context = np.repeat(np.arange(len(lists)), lengths)
    fits = np.flatnonzero(np.arange(len(units)) + WINDOW <= ends[context])
    if not len(fits):
        return np.zeros((0, 3), np.int64)
    hashes = common.mix(np.arange(1, len(letters) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = common.mix(anchors.Rolling(units, hashes).span(fits, fits + WINDOW)) ^ group[context[fits]].astype(np.uint64)
    own = context[fits]
    at = places[own, 2] + fits - starts[own]
    order = np.lexsort((at, places[own, 1], places[own, 0], key))
    fits, own, key, at = fits[order], own[order], key[order], at[order]
    new = ~anchors.same_as_before(key)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    equal = np.ones(len(fits), bool)
    for j in range(WINDOW):  # word by word
        equal &= units[fits + j] == units[fits[head] + j]
    another = equal & ~anchors.same_as_before(key, places[own, 0], places[own, 1], at)
    times = np.add.reduceat(another.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    again = np.zeros(len(units) + 1, bool)
    again[fits[equal & (times > 1) & ~several[own]]] = True
    edge = np.diff(np.append(False, again).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = context[a]
    return np.column_stack([numbers[row], a - starts[row], b - starts[row] + WINDOW - 1])


def lines_of(lists: list[list[bytes]], alphabet: int = LETTERS) -> tuple[list[str], int]:
    """(each list of words as a string, letters per word): one while the alphabet suffices for all different words, else two."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
    letter = lambda k: chr(k + 1 if k + 1 < 0xD800 else k + 0x801)  # noqa: E731 (strings can't hold the 0x800 codes from 0xD800 on)
    if len(numbers) <= alphabet:
        width, codes = 1, {w: letter(k) for w, k in numbers.items()}
    else:
        width, codes = 2, {w: letter(k // alphabet) + letter(k % alphabet) for w, k in numbers.items()}
    return ["".join(map(codes.__getitem__, words)) for words in lists], width


def automata(phrases: list[str], shard: int = SHARD) -> Iterator:
    """Aho-Corasick automata of shards of the phrases; a match's value is its phrase's length."""
    import ahocorasick

    automaton, size = ahocorasick.Automaton(), 0
    for k, phrase in enumerate(phrases):
        automaton.add_word(phrase, len(phrase))
        size += len(phrase)
        if size >= shard or k == len(phrases) - 1:
            automaton.make_automaton()
            yield automaton
            automaton, size = ahocorasick.Automaton(), 0


def occurrences(lists: list[list[bytes]], phrases: list[tuple[int, int, int]], shard: int = SHARD, alphabet: int = LETTERS) -> list[np.ndarray]:
    """(first word, end word) of every occurrence in each list of words of the phrases (list, first word, end word)."""
    lines, width = lines_of(lists, alphabet)
    hits: list[list] = [[] for _ in lists]
    for automaton in automata([lines[d][width * a : width * b] for d, a, b in phrases], shard):
        for line, own in zip(lines, hits, strict=True):
            own += [(end + 1 - n, end + 1) for end, n in automaton.iter(line) if (end + 1) % width == 0]
    return [np.array(own, np.int64).reshape(-1, 2) // width for own in hits]


def needed(phrases: list[tuple[int, int, int]], several: list[bool]) -> list[tuple[int, int, int]]:
    """The phrases (document, first word, end word) without those whose words others of the document cover.

    A phrase of a passage that a group has at several places stays, as it has to be found at the other ones as well.
    """
    kept: list[tuple[int, int, int, bool, int]] = []  # with the largest end up to there
    out: list[tuple[int, int, int]] = []
    own = None
    for d, a, b, stays in sorted(((d, a, b, s) for (d, a, b), s in zip(phrases, several, strict=True)), key=lambda x: (x[0], x[1], -x[2])):
        if d != own:
            out += [x[:3] for x in kept]
            kept, own = [], d
        if kept and b <= kept[-1][4] and not stays:
            continue
        while len(kept) > 1 and not kept[-1][3] and a <= kept[-2][4] and b >= kept[-1][2]:
            kept.pop()
        kept.append((d, a, b, stays, max(b, kept[-1][4]) if kept else b))
    return out + [x[:3] for x in kept]


def _told(confirmed: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(passage, (first word, end word)) of a group's list of struct(passage, phrases)."""
    if confirmed.values is None:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int32)
    passage, phrases = confirmed.values.field("passage"), confirmed.values.field("phrases")
    data, starts = common.bytes_of(phrases)
    return np.repeat(passage.to_numpy().astype(np.int64), np.diff(starts) // 8), np.frombuffer(data.tobytes(), "<i4").reshape(-1, 2)


Finish = Callable[[list[bytes], np.ndarray], tuple]


def locate(docs: DataFrame, finish: Finish, schema: str, hot: int = anchors.HOT, grouped: int = GROUPED) -> DataFrame:
    """doc_id and the values of `schema` that finish(words, merged ranges of recurring words) gives, for every row of docs.

    hot: contexts from which on a gram is split; grouped: bytes of text in a group.
    """
    found = anchors.meet(docs, units_of, SHAPE, hot)
    texts = anchors.squeezed(docs).join(anchors.of_kind(found, anchors.POINTS, "points"), ["doc_id", "tie"], "left")
    groups = _groups(texts, anchors.hot_grams(found), grouped)
    confirmed = common.in_arrow(anchors.dealt(_passages(groups)), _confirm, "id binary, phrases binary")
    # A passage that a third of all groups have makes one large key of `_asks`; the other side has one row of it, so Spark may split it.
    told = _asks(groups).join(confirmed, "id")
    phrases = told.groupBy("group").agg(F.collect_list(F.struct("passage", "phrases")).alias("phrases"))
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    targets = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, confirmed in zip(batch.column("packed"), batch.column("phrases"), strict=True):
                members, passages = pickle.loads(opener.decompress(packed.as_buffer()))
                lists = [text.split() for _, _, text in members]
                own, pairs = _told(confirmed)
                of, low = passages["doc"][own].tolist(), passages["low"][own].astype(np.int64)
                phrases = list(zip(of, (low + pairs[:, 0]).tolist(), (low + pairs[:, 1]).tolist(), strict=True))
                hits = occurrences(lists, needed(phrases, passages["several"][own].tolist()))
                rows = []
                for (doc_id, _, _), words, pairs in zip(members, lists, hits, strict=True):
                    rows.append((None if doc_id == anchors.NULL_ID else doc_id, *finish(words, anchors.merged(*pairs.T) if len(pairs) else pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *targets), strict=True)], names=["doc_id", *names])

    return common.in_arrow(groups.join(phrases, "group", "left").select("packed", "phrases"), stream, f"doc_id long, {schema}")


def kept_words(words: list[bytes], ranges: np.ndarray) -> list[bytes]:
    edges = [0, *ranges.reshape(-1).tolist(), len(words)]
    return [w for k in range(0, len(edges), 2) for w in words[edges[k] : edges[k + 1]]]


def _digest(words: list[bytes], ranges: np.ndarray) -> tuple:
    return len(words), int((ranges[:, 1] - ranges[:, 0]).sum()), hashlib.sha256(b" ".join(kept_words(words, ranges))).hexdigest()


def dedup(docs: DataFrame, hot: int = anchors.HOT, grouped: int = GROUPED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return locate(docs, _digest, "n_words long, n_removed long, kept_sha256 string", hot, grouped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents"))


QUERY = ("op10_phrase_dedup", query, None)
