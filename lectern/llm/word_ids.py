"""Token ids of texts by a ``tokenizers`` vocabulary of words with word ends (the last token of a pre-token is marked).

A slice of texts is one array of bytes.  Characters fall into four classes (space, letter, digit, other), which are asked of the
library's own normaliser and pre-tokenizer, and array operations cut the slice into pre-tokens.  Arrow's dictionary encoding
finds the distinct ones, and only those that the worker has not met go to the library, many in one call.  A table of
their ids stays in the worker, and a text's ids are gathered from it.  The ids are those that the library gives for the
whole text.

This way is for texts of Latin-1 characters, where one byte is one character and no character composes with its
neighbour.  Other texts, and those with the opening of a special token, are cut at spaces and line feeds, and the stretches
go to the library as they are.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bounds of a worker's tables. Longer pre-tokens are encoded each time they are met.
CACHE_ENTRIES, CACHED_BYTES = 600_000, 48
#: Bytes that are cut at once; a text beyond this is cut at a space.
BLOCK = 4 << 20
#: Rows that callers hand over at once.
BATCH_ROWS = 8192
#: What follows an apostrophe in the pre-tokens that contractions are.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSAFE = range(5)
_workers: dict = {}


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.pretokens = path, Tokenizer.from_file(path)
        vocabulary = self.pretokens.get_vocab(with_added_tokens=True)
        self.highest = max(vocabulary.values())
        self.ends = np.zeros(self.highest + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.between = "<|startoftext|>"
        self.mark = self.pretokens.token_to_id(self.between)
        self.classes, self.mapped = self._characters()
        #: From here on for pre-tokens with spaces between them.
        self.pretokens.normalizer = None
        self.pretokens.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.safe = bytes(np.flatnonzero(self.classes != _UNSAFE).astype(np.uint8))
        self.stretches: dict[str, bytes] = {}
        self.reset()

    def _characters(self) -> tuple[np.ndarray, bytes]:
        """Class of each Latin-1 character and what the normaliser makes of it, as the library has them."""
        cut, normal = self.pretokens.pre_tokenizer.pre_tokenize_str, self.pretokens.normalizer.normalize_str
        classes, mapped = np.full(256, _UNSAFE, np.uint8), bytearray(range(256))
        for c in range(256):
            s = normal(chr(c))
            if len(s) == 1 and s <= "\xff":
                pair = len(cut(s + s))
                classes[c] = _SPACE if not pair else _DIGIT if pair == 2 else _LETTER if len(cut("a" + s)) == 1 else _OTHER
                mapped[c] = 32 if not pair else ord(s)
        return classes, bytes(mapped)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer as it is, for what the arrays cannot take."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.at, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.entries, self.used = 0, 0

    def learn(self, words: list[bytes]) -> None:
        """Put the ids of pre-tokens into the tables."""
        texts = [w.decode("latin-1") for w in words]
        found = self.pretokens.encode_batch_fast([" ".join(texts[i : i + 1000]) for i in range(0, len(texts), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):  # a pre-token that the simple cut takes apart
            each = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids, last = np.concatenate(each), np.cumsum([len(x) for x in each])
        n, m = self.entries + len(words), self.used + len(ids)
        for name, least in (("at", n), ("size", n), ("ids", m)):
            old = getattr(self, name)
            if least > len(old):
                new = np.zeros(2 * least, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.ids[self.used : m] = ids
        self.size[self.entries : n] = np.diff(last, prepend=0)
        self.at[self.entries : n] = self.used + last - self.size[self.entries : n]
        self.seen.update(zip(words, range(self.entries, n), strict=True))
        self.entries, self.used = n, m

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The table's entries of pre-tokens, with or without spaces behind them."""
        if len(self.seen) > CACHE_ENTRIES or self.used > 4 * CACHE_ENTRIES:
            self.reset()
        seen = self.seen
        found = np.fromiter(map(seen.get, keys, repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(found < 0)
        if len(lost):
            more = [keys[i] for i in lost.tolist()]
            bare = [k.rstrip(b" ") for k in more]
            if new := [w for w in dict.fromkeys(bare) if w not in seen]:
                self.learn(new)
            found[lost] = own = [seen[w] for w in bare]
            seen.update(zip(more, own, strict=True))
            for long in {k for k in (*more, *bare) if len(k) > CACHED_BYTES}:
                del seen[long]
        return found

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pre-tokens of normalised bytes: where each begins, the number of its ids, and all ids."""
        chars = np.frombuffer(data, np.uint8)
        kind = self.classes[chars]
        begin = np.empty(len(kind), bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= kind == _DIGIT
        begin &= kind != _SPACE
        if b"'" in data:
            self._contractions(data, chars, kind, begin)
        starts = np.flatnonzero(begin)
        if not len(starts):
            return starts, starts, np.empty(0, np.int32)
        ends = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        entry = self.numbers(_pieces(words.dictionary))[words.indices.to_numpy()]
        size = self.size[entry]
        total = np.cumsum(size)
        return starts, size, self.ids[np.repeat(self.at[entry] - total + size, size) + np.arange(total[-1])]

    @staticmethod
    def _contractions(data: bytes, chars: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> None:
        """An apostrophe that begins a pre-token and the letters of a contraction are one; what follows them is another."""
        n = len(chars)
        for p in np.flatnonzero((chars == 39) & begin).tolist():
            for c in CONTRACTIONS:
                if data.startswith(c.encode(), p + 1):
                    begin[p + 1] = False
                    if (end := p + 1 + len(c)) < n and kind[end] == _LETTER:
                        begin[end] = True
                    break

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text of safe characters, and all ids."""
        data = b" ".join(texts).translate(self.mapped)
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        count, out, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(data):
            end = len(data)
            if end - at > BLOCK:
                end = data.rfind(b" ", at, at + BLOCK) + 1 or (data.find(b" ", at + BLOCK) + 1 or end)
            starts, size, ids = self.block(data[at:end])
            owner = np.searchsorted(edge, starts + at, "right") - 1
            count += np.bincount(owner, size, len(texts)).astype(np.int64)
            out.append(ids)
            at = end
        return count, np.concatenate(out) if out else np.empty(0, np.int32)

    def other(self, text: str) -> np.ndarray:
        """Ids of any text, by its stretches between spaces and line feeds."""
        parts = text.replace("\n", " ").split(" ")
        missing = [w for w in dict.fromkeys(parts) if w not in self.stretches]
        if len(self.stretches) + len(missing) > CACHE_ENTRIES // 4:
            self.stretches, missing = {}, list(dict.fromkeys(parts))
        for at in range(0, len(missing), 20_000):
            self.stretches.update(zip(some := missing[at : at + 20_000], self.encode_stretches(some), strict=True))
        out = b"".join(map(self.stretches.__getitem__, parts))
        for w in missing:
            if len(w) > CACHED_BYTES:
                del self.stretches[w]
        return np.frombuffer(out, np.int32)

    def encode_stretches(self, words: list[str]) -> list[bytes]:
        """One call for many stretches: a special token between them shows where each ends."""
        if not any("<|" in w for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(words)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                return [x[1 if i else 0 :].tobytes() for i, x in enumerate(np.split(ids, cuts))]
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: Sequence[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as 32-bit integers, and where each text's begin and end. A null is empty; ``end_id`` closes each text."""
        raw: list[bytes] = []
        place: list[int] = []
        others: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if text:
                try:
                    data = text.encode("latin-1")
                except UnicodeEncodeError:
                    data = None
                if data is None or b"<|" in data or data.translate(None, self.safe):
                    others[i] = self.other(text)
                else:
                    place.append(i)
                    raw.append(data)
        count = np.zeros(len(texts), np.int64)
        count[place], ids = self.plain(raw)
        for i, own in others.items():
            count[i] = len(own)
        extra = end_id is not None
        first = np.concatenate([[0], np.cumsum(count + extra)])
        if not extra and not others:
            return first, ids
        out = np.empty(first[-1], np.int32)
        n = count[place]
        out[np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        for i, own in others.items():
            out[first[i] : first[i] + len(own)] = own
        if extra:
            out[first[1:] - 1] = end_id
        return first, out


def _pieces(values: pa.Array) -> list[bytes]:
    _, ends, data = values.buffers()
    cuts, data = np.frombuffer(ends, np.int32, len(values) + 1, values.offset * 4).tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_ids(path: str) -> WordIds:
    """This worker's encoder."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def binary_ids(first: np.ndarray, ids: np.ndarray, width: int) -> pa.Array:
    """Each text's ids as little-endian integers of so many bytes in an Arrow binary."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((width * first).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
