"""Encoding whole texts with a public tokenizer, once for each distinct word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white-space characters in a row, of any kind: there the encoder's own splitting looks further than one word.
_LINKED = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]{2}"
#: Letters below this one are letters in every version of Unicode; words of others are left to the library's own splitting.
_SURE = "\u0250"
#: Marks the first word of a line in a key; texts that hold it are encoded whole.
_FIRST = "\0"
_TAIL = ".,!?;:"
#: How a byte-level vocabulary writes bytes: visible Latin-1 characters as themselves, the others from U+0100 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_WRITTEN = np.arange(256, dtype="<u4")
_WRITTEN[_HIDDEN] = np.arange(256, 256 + len(_HIDDEN))
#: Words that are merged with one call.
_AT_ONCE = 50
#: Words that are held as Python strings at once.
_LEARNED = 40_000
_OPEN: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The process's encoder for a file: tasks that follow each other in a worker share its words."""
    if path not in _OPEN:
        _OPEN[path] = TextEncoder(path)
    return _OPEN[path]


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.large_string())


class _Table:
    """Ids of words, as arrays: word k has ids[starts[k] : starts[k] + sizes[k]]. seen: in how many slices it occurred."""

    def __init__(self) -> None:
        self.words = _strings([])
        self.ids, self.starts, self.sizes, self.seen = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, words: pa.Array, ids: list[bytes]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        self.sizes, self.seen = np.append(self.sizes, sizes), np.append(self.seen, np.zeros(len(ids), np.int32))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, where each word's end)."""
        n = self.sizes[rows]
        ends = np.cumsum(n)
        at = np.repeat((self.starts[rows] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends

    def forget(self) -> None:
        """Drop the words that occurred in one slice only."""
        rows = np.flatnonzero(self.seen > 1)
        ids, ends = self.gather(rows)
        self.words, self.sizes, self.ids = self.words.take(pa.array(rows)), self.sizes[rows], ids
        self.starts, self.seen = ends - self.sizes, np.zeros(len(rows), np.int32)


class TextEncoder:
    """Ids of texts from a byte-level BPE file of the `tokenizers` library.

    That vocabulary never joins characters across the border between a non-space and a following space or line end, nor
    between a letter and a following mark, so a text's ids are those of its words, line ends and marks, one after another.
    Words repeat; each is encoded once and kept, until there are `keep` words. Texts with two white-space characters in a
    row, where the splitting looks ahead, and texts that hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [_FIRST]
        #: Words of letters are one piece each: only merging is left to do.
        self.merger = Tokenizer.from_file(path)
        self.merger.pre_tokenizer = CharDelimiterSplit(chr(_WRITTEN[10]))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.keep, self.table = keep, _Table()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters with or without a space in front. Token lengths tell where each word's ids end."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        written = _WRITTEN[np.frombuffer(b"\n".join(raw), np.uint8)].tobytes().decode("utf-32-le")
        lows = (np.cumsum(sizes + 1) - sizes - 1)[::_AT_ONCE].tolist() + [len(written) + 1]
        merged = self.merger.encode_batch_fast([written[a : b - 1] for a, b in zip(lows, lows[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in merged])
        ends = (4 * np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 4).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _ids_of(self, keys: list[str]) -> list[bytes]:
        """A key is a line end, a line's first word after _FIRST, or another word."""
        plain = lambda k: k[1:] if k[:1] == _FIRST else k if k == "\n" else f" {k}"
        stems = [key.rstrip(_TAIL) for key in keys]
        letters = dict.fromkeys(s for s in stems if s.removeprefix(_FIRST).isalpha() and max(s) < _SURE)
        letters = dict(zip(letters, self._merge(list(map(plain, letters))), strict=True))
        tails = list(dict.fromkeys(k[len(s) :] for k, s in zip(keys, stems, strict=True) if s in letters))
        tails = dict(zip(tails, self._encode(tails), strict=True))
        others = iter(self._encode([plain(k) for k, s in zip(keys, stems, strict=True) if s not in letters]))
        return [letters[s] + tails[k[len(s) :]] if s in letters else next(others) for k, s in zip(keys, stems, strict=True)]

    def _rows(self, keys: pa.Array) -> np.ndarray:
        """Where distinct keys stand in the table; new ones are added."""
        found = pc.index_in(keys, value_set=self.table.words)
        new = keys.filter(found.is_null())
        rows = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            rows[rows < 0] = np.arange(len(new)) + len(self.table.words)
            for low in range(0, len(new), _LEARNED):
                part = new.slice(low, _LEARNED)
                self.table.add(part, self._ids_of(part.to_pylist()))
        self.table.seen[rows] += 1
        return rows

    def _by_word(self, texts: pa.Array) -> list[bytes]:
        if len(self.table.words) > self.keep:
            self.table.forget()
        text = lambda x: pa.scalar(x, pa.large_string())
        keyed = pc.binary_join_element_wise(text(_FIRST), pc.replace_substring(texts, "\n", f" \n {_FIRST}"), text(""))
        lists = pc.split_pattern(keyed, " ")
        words = lists.flatten().dictionary_encode()
        ids, ends = self.table.gather(self._rows(words.dictionary)[words.indices.to_numpy()])
        flat, bounds = memoryview(ids.tobytes()), (4 * np.append(0, ends)[lists.offsets.to_numpy()]).tolist()
        return [bytes(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """For each text of a column its ids as little-endian unsigned 32-bit integers; null is empty."""
        texts = column.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, _LINKED)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        apart = texts.filter(pc.invert(whole))
        words = iter(self._by_word(apart) if len(apart) else [])
        others = iter(self._encode(texts.filter(whole).to_pylist()))
        return [next(others) if x else next(words) for x in whole.to_pylist()]
