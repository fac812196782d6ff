"""Words and shingles of an Arrow string column as 64-bit hashes, found with array operations over its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = U(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Anything but ASCII letters, digits and the bytes of other characters.
_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers, so that near numbers differ in all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mixed(np.arange(1, 257, dtype=U) * _PRIME)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z


def _inverse() -> int:
    return pow(int(_PRIME), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, U)]), dtype=U)


_cache: dict = {}
PART_BYTES = 2 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; a null is empty."""
    texts = pa.chunked_array([texts]).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, ends, values = texts.buffers()
    at = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and at[-1] else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array, ascii_words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash, first byte and end byte in its text; and where each text's words begin.

    A word is a run of anything but the six ASCII space characters, or with ``ascii_words`` of anything but ASCII
    characters that are no letter or digit.  A-Z count as a-z.  Texts go in parts of about ``PART_BYTES``, as some ten numbers
    are held for each byte.
    """
    parts = [_word_hashes(part, ascii_words) for part in _parts(texts)]
    if len(parts) == 1:
        return parts[0]
    hashes, starts, ends = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
    shift = np.cumsum([0, *(p[3][-1] for p in parts)])
    return hashes, starts, ends, np.concatenate([[0], *(p[3][1:] + n for p, n in zip(parts, shift, strict=False))])


def _parts(texts: pa.Array) -> list[pa.Array]:
    """Runs of whole texts of about ``PART_BYTES``, one at least."""
    size = texts.nbytes
    if size <= PART_BYTES or len(texts) < 2:
        return [texts]
    _, at = text_bytes(texts)
    cuts = np.unique(np.searchsorted(at, np.arange(PART_BYTES, at[-1], PART_BYTES)))
    edges = [0, *(int(c) for c in cuts if 0 < c < len(texts)), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _word_hashes(texts: pa.Array, ascii_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = text_bytes(texts)
    n = len(data)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    if _cache.get("n", 0) < n:
        _cache.update(n=n, up=_powers(int(_PRIME), n), down=_powers(_inverse(), n))
    gap = (_NO_WORD if ascii_words else _SPACE)[data]
    word = np.empty(n + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~gap
    starts, ends = np.flatnonzero(np.diff(word) == 1), np.flatnonzero(np.diff(word) == -1)
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    inner = np.unique(inner)
    inner = inner[~gap[inner] & ~gap[inner - 1]]  # a text's end is a word's end
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * _cache["up"][:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _cache["down"][starts] + (ends - starts).astype(U))
    first = np.searchsorted(starts, at)
    owner = np.repeat(at[:-1], np.diff(first))
    return hashes, starts - owner, ends - owner, first


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word; the last k - 1 are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _PRIME
        out += words[i : i + n]
    return mixed(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of k words, in order with repeats, and where each text's begin. A text with fewer
    words has one shingle, the whole sequence; a text without words has none."""
    count = np.diff(first)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], U)
    full = runs(words, k)
    long = count >= k
    which = np.repeat(first[:-1][long] - at[:-1][long], size[long]) + (np.arange(at[-1])[np.repeat(long, size)])
    out[np.repeat(long, size)] = full[which]
    for i in np.flatnonzero((count > 0) & ~long):
        h = U(0)
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                h = h * _PRIME + w
            out[at[i]] = mixed(np.array([h + U(count[i])], U))[0]
    return out, at
