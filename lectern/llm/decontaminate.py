"""Operator 3: benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item of L words leaks where a stretch of a text is within k = floor(MOST_EDITS * L) word edits of it.

1. A text's windows of L words are found around seeds: an item cut into k + 1 pieces has one piece unchanged in every
   stretch within k edits, so windows that hold no piece of any item cannot match, and only the windows up to k words
   around a piece's place are embedded.  This loses nothing.
2. The CGK random walk embeds windows and items: at each of 3L steps it emits the current word and moves on if the
   step's random bit for that word says so, which turns word edits into few Hamming differences.
3. Bit-sampling LSH: each of ``REPEATS`` walks samples ``SAMPLED`` steps as a key; window and item of one key are
   candidates.  ``REPEATS`` follows from ``AGREE``, the share of equal steps at the edit bound, and ``RECALL``.
4. Exact edit distance of the item to the stretch around the window confirms a candidate.

An item of more than ``PART`` words is sought by its parts of at most ``PART`` words, as walks that have lost step stay apart
in long windows and ``AGREE`` would not hold.  Under k edits one part of length P at least has floor(MOST_EDITS * P) edits at
most (else there were more than k in all), so steps 1 to 3 hold for that part; step 4 is of the whole item.

Words are runs of letters and digits, without case.  Items are taken in blocks of ``ITEM_BLOCK``, so what is broadcast has a
bound; each block reads the texts once.

Edge cases: items and texts that are null, empty or without a word match nothing; items with equal texts each match;
an item found several times in a text is one row, with its best place; repeated rows give repeated results; empty
tables give no rows; other columns of either input are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices
from lectern.llm.hashing import U, mixed, runs, word_hashes

MOST_EDITS, SAMPLED, AGREE, RECALL = 0.2, 2, 0.35, 0.99
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))
ITEM_BLOCK, PART, SLICE_BYTES, CHUNK = 5000, 60, 1 << 20, 1024
_PAD = U(0)
_workers: dict = {}


def bound(words: int) -> int:
    return int(MOST_EDITS * words)


def keys(windows: np.ndarray) -> np.ndarray:
    """LSH keys (windows, REPEATS) of windows of L word hashes."""
    n, length = windows.shape
    draw = np.random.default_rng(length)
    steps = 3 * length
    mult = draw.integers(0, 1 << 63, (steps, REPEATS), dtype=U) * U(2) + U(1)
    taken = np.zeros((steps, REPEATS), bool)
    for r in range(REPEATS):
        taken[draw.choice(int(1.5 * length) + 1, SAMPLED, replace=False), r] = True  # a walk has about passed the window by step 2L
    padded = np.concatenate([windows, np.full((n, 1), _PAD)], axis=1)
    at = np.zeros((n, REPEATS), np.int64)
    key = np.zeros((n, REPEATS), U)
    rows = np.arange(n)[:, None]
    for j in range(int(1.5 * length) + 1):
        word = padded[rows, at]
        if taken[j].any():
            key = np.where(taken[j], (key ^ word) * U(0x9E3779B97F4A7C15) + U(j + 1), key)
        at = np.minimum(at + ((word * mult[j]) >> U(63)).astype(np.int64), length)
    return mixed(key)


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a stretch of the text, and the stretch (start, end)."""
    n = len(text)
    cost, start, steps = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, w in enumerate(item, 1):
        diagonal, up = cost[:-1] + (text != w), cost[1:] + 1
        new, begin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], begin[0] = i, 0
        new[1:], begin[1:] = np.where(diagonal <= up, diagonal, up), np.where(diagonal <= up, start[:-1], start[1:])
        run = np.minimum.accumulate((new - steps) * (n + 2) + steps)  # the best place to insert from
        source = run % (n + 2)
        left = (run - source) // (n + 2) + steps
        cost, start = np.where(left < new, left, new), np.where(left < new, begin[source], begin)
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """The items' parts as (item, place, words), the parts' pieces, by length, and their keys, by number of words."""

    def __init__(self, texts: list[str]) -> None:
        hashes, _, _, first = word_hashes(pa.array(texts, pa.large_string()), ascii_words=True)
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.parts: list[tuple[int, int, np.ndarray]] = []
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), -(-len(w) // PART) + 1).astype(int)
            self.parts += [(i, int(a), w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        pieces: dict[int, list] = {}
        by_length: dict[int, list[int]] = {}
        for i, (_, _, w) in enumerate(self.parts):
            by_length.setdefault(len(w), []).append(i)
            cuts = np.linspace(0, len(w), bound(len(w)) + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(int(b - a), []).append((runs(w[a:b], int(b - a))[0], i, int(a)))
        self.pieces = {}
        for p, rows in pieces.items():
            rows.sort()
            value = np.array([r[0] for r in rows], U)
            low = np.zeros(1 << 20, bool)
            low[value & U((1 << 20) - 1)] = True
            self.pieces[p] = (value, np.array([len(self.parts[r[1]][2]) for r in rows]), np.array([r[2] for r in rows]), low)
        self.keys = {n: (np.array(ids), keys(np.stack([self.parts[i][2] for i in ids]))) for n, ids in by_length.items()}

    def windows(self, words: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """By number of words: the starts of the windows around seeds."""
        found: dict[int, list] = {}
        for p, (value, length, offset, low) in self.pieces.items():
            here = runs(words, p)
            at = np.flatnonzero(low[here & U((1 << 20) - 1)])
            lo, hi = np.searchsorted(value, here[at], "left"), np.searchsorted(value, here[at], "right")
            owner = np.searchsorted(first, at, "right")
            count = np.where(at + p <= first[np.minimum(owner, len(first) - 1)], hi - lo, 0)
            row = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            start = np.repeat(at, count) - offset[row]
            text = np.repeat(owner - 1, count)
            for n in np.unique(length[row]).tolist():
                own, k = length[row] == n, bound(n)
                near = (start[own][:, None] + np.arange(-k, k + 1)).ravel()
                found.setdefault(n, []).append(np.stack([np.repeat(text[own], 2 * k + 1), near]))
        return {n: np.unique(np.concatenate(x, axis=1), axis=1) for n, x in found.items()}

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word), the best place of each item in each text."""
        words, _, _, first = word_hashes(texts, ascii_words=True)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        begins: dict[tuple[int, int], set[int]] = {}
        for n, found in self.windows(words, first).items():
            ids, item_keys = self.keys[n]
            k = bound(n)
            order = [np.argsort(item_keys[:, r], kind="stable") for r in range(REPEATS)]
            tested: dict[tuple[int, int], int] = {}
            for at in range(0, found.shape[1], CHUNK):
                text, start = found[:, at : at + CHUNK]
                place = start[:, None] + np.arange(n)
                inside = (place >= first[text][:, None]) & (place < first[text + 1][:, None])
                window = np.where(inside, words[np.where(inside, place, 0)], _PAD)
                own = keys(window)
                pairs = set()
                for r in range(REPEATS):
                    sorted_keys = item_keys[order[r], r]
                    lo, hi = np.searchsorted(sorted_keys, own[:, r], "left"), np.searchsorted(sorted_keys, own[:, r], "right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        pairs.update((i, int(ids[order[r][x]])) for x in range(lo[i], hi[i]))
                for i, part in sorted(pairs):
                    t, s = int(text[i]), int(start[i])
                    item, offset, _ = self.parts[part]
                    if n < len(self.words[item]):
                        begins.setdefault((t, item), set()).add(s - offset)
                        continue
                    if s - tested.get((t, item), -(1 << 60)) <= k and (t, item) in best and best[t, item][0] == 0:
                        continue
                    tested[t, item] = s
                    if np.array_equal(window[i], self.words[item]):
                        d, a, b = 0, s, s + n
                    else:
                        lo_word, hi_word = max(int(first[t]), s - k), min(int(first[t + 1]), s + n + k)
                        d, a, b = nearest(self.words[item], words[lo_word:hi_word])
                        a, b = a + lo_word, b + lo_word
                    if d <= k and (d, a - int(first[t])) < best.get((t, item), (1 << 60, 0, 0))[:2]:
                        best[t, item] = (d, a - int(first[t]), b - int(first[t]))
        for (t, item), found in begins.items():
            whole = self.words[item]
            k, at = bound(len(whole)), np.array(sorted(found))
            cuts = np.flatnonzero(np.diff(at) > len(whole) + 4 * k) + 1  # stretches that overlap are searched as one
            for near in np.split(at, cuts):
                lo_word, hi_word = max(int(first[t]), int(near[0]) - 2 * k), min(int(first[t + 1]), int(near[-1]) + len(whole) + 2 * k)
                if np.isin(whole, words[lo_word:hi_word]).sum() < len(whole) - k:  # each missing word is an edit
                    continue
                d, a, b = nearest(whole, words[lo_word:hi_word])
                a, b = a + lo_word - int(first[t]), b + lo_word - int(first[t])
                if d <= k and (d, a) < best.get((t, item), (1 << 60, 0, 0))[:2]:
                    best[t, item] = (d, a, b)
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items in blocks; one block, if only an empty one, at least."""
    named = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    block: list = []
    none = True
    for row in named.toLocalIterator():
        block.append(row)
        if len(block) == ITEM_BLOCK:
            yield [r.item for r in block], [r.text for r in block]
            block, none = [], False
    if block or none:
        yield [r.item for r in block], [r.text for r in block]


def _known(held, key: str) -> Items:
    if key not in _workers:
        _workers.clear()
        _workers[key] = Items(held.value[1])
    return _workers[key]


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each text and item that leaks into it: id, item id, distance, similarity, first_word, end_word."""
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType, items.schema[item_id_col].dataType]
    schema = T.StructType([T.StructField("id", kinds[0]), T.StructField("item", kinds[1]), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts in item_blocks(items, item_id_col, item_text_col):
        held, key = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            known = _known(held, key)
            for batch in batches:
                for part in slices(batch, 1000, SLICE_BYTES):
                    rows = known.matches(part.column(1))
                    if rows:
                        text, item, d, a, b = (np.array(x) for x in zip(*rows, strict=True))
                        share = [1 - x / len(known.words[i]) for x, i in zip(d.tolist(), item.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array([held.value[0][i] for i in item.tolist()]), pa.array(d.astype(np.int32)), pa.array(share), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], schema.names)

        found = read.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out.toDF(id_col, item_id_col if item_id_col != id_col else "item", *schema.names[2:])


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows into whose texts no item leaks, as they are."""
    out, place = docs, docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col):
        held, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            known = _known(held, key)
            for batch in batches:
                for part in slices(batch, 1000, SLICE_BYTES):
                    clean = np.ones(part.num_rows, bool)
                    clean[[row[0] for row in known.matches(part.column(place))]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
