"""Operator 13: runs of repeated passages, by tiles of each octave of periods.

A run is a stretch of consecutive words whose words at a distance q are equal, q being its smallest period, that has at least
max(``LEAST``, 2 q) words and that no neighbouring word extends.

1. A text is cut into overlapping tiles for each octave of periods (low <= q < high).  Tiles of one octave overlap by twice the
   greatest period, so a run that several tiles see leaves in each of them a fragment that meets the next one's.
2. A tile is solved by itself, by Z-functions at boundaries that stand so close that each fragment covers one: how far the words from
   a boundary on, and those before it, agree with the words q further on.  Z-values are found for all boundaries and periods of a
   tile together, on hashes of 2^j words (each mixed from two of 2^(j - 1)): values that are too small for a fragment end at the first
   comparison, those of boundaries in a row are one fragment, and its two ends are stretched by halves.  Fragments whose passage
   repeats a shorter one go: such a fragment is as long as two periods, so the whole run has the shorter period.
3. Fragments are shuffled by document and period, and those that meet are stitched into a run.

The work of an octave is about two comparisons a word, so a text of n words costs n log n.  Tiles are solved where the text is read;
those of a text of more than ``LONG`` words are dealt over all tasks, as hashes of their words.  A tile takes about 8 log2(n) bytes a word.

Words are compared by 64-bit hashes, blocks of words by mixed hashes; two different ones agree with a probability of 2^-64.

Edge cases: null and empty texts, and texts without a word, have no runs and an empty text; repeated rows each get the same result; rows
with one id and different texts are told apart by a hash of the text; a null id is an id; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WORD, Scratch, materialised, slices, words_of
from lectern.llm.hashing import U, mixed

#: Words of a run at least; words of a tile at least; words of a text whose tiles are dealt out.
LEAST, TILE, LONG = 12, 4096, 1 << 18
_STEP = U(0x9E3779B97F4A7C15)
_FRAGMENTS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("period", "first", "stop")]))
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "period", "length")])


def octaves(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, block, step) of the periods low <= q < high that a run of n words can have.  A fragment of such a period has
    block + step - 1 equal places at least, so a block of them begins at a multiple of step."""
    if n >= LEAST:
        yield 1, 8, 4, 3
    low = 8
    while 2 * low <= n:
        yield low, 2 * low, low // 2, low // 2
        low *= 2


def tiles(n: int) -> Iterator[tuple[int, int, int]]:
    """(low, begin, end) of the tiles of a text of n words."""
    for low, high, _, _ in octaves(n):
        size, at = max(TILE, 8 * high), 0
        yield low, at, min(n, size)
        while at + size < n:
            at += size - 2 * high
            yield low, at, min(n, at + size)


def levels(words: np.ndarray, block: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... up to ``block`` words from each place on."""
    out, k = [words], 1
    while 2 * k <= block and len(out[-1]) > k:
        last = out[-1]
        out.append(mixed(last[:-k] * _STEP + last[k:]))
        k *= 2
    return out


_factors = np.arange(2)


def _smallest_factor(n: int) -> np.ndarray:
    """The smallest prime factor of each number up to n."""
    global _factors
    if len(_factors) <= n:
        size = max(1024, 2 * n)
        own = np.arange(size)
        for p in range(2, int(size**0.5) + 1):
            if own[p] == p:
                multiples = own[p * p :: p]
                multiples[multiples == np.arange(p * p, size, p)] = p
        _factors = own
    return _factors


_NONE = np.empty((3, 0), np.int64)


def solved(hashes: list[np.ndarray], low: int, at: int, end: int) -> np.ndarray:
    """Fragments of the words at <= i < end, whose ``levels`` are given, with periods of the octave from ``low`` on: period, first
    place, and the place behind the last one, of the places whose word equals the one a period further on."""
    high, block, step = next((h, b, s) for x, h, b, s in octaves(end - at) if x == low)
    level, size = block.bit_length() - 1, end - at
    own = hashes[level][at : end - block + 1]
    places = np.arange(0, len(own) - low, step)
    if not len(places):
        return _NONE
    # row i holds the blocks that begin low to high - 1 words after place i
    padded = np.concatenate([own, np.zeros(high + step, U)])
    ahead = np.ndarray((len(places), high - low), U, padded, 8 * low, (8 * step, 8))
    row, period = np.nonzero(ahead == own[places][:, None])
    if not len(row):
        return _NONE
    first, period = row * step, period + low
    inside = first + period < len(own)
    first, period = first[inside], period[inside]
    order = np.argsort(period * (size + 1) + first, kind="stable")
    first, period = first[order], period[order]
    opens = np.ones(len(first), bool)
    opens[1:] = (np.diff(period) != 0) | (np.diff(first) != step)
    closes = np.append(opens[1:], True)
    stop, first, period = first[closes] + block, first[opens], period[opens]
    for j in range(level - 1, -1, -1):
        k, h = 1 << j, hashes[j][at:]
        may = np.flatnonzero(first >= k)
        first[may] -= k * (h[first[may] - k] == h[first[may] - k + period[may]])
        may = np.flatnonzero(stop + period + k <= size)
        stop[may] += k * (h[stop[may]] == h[stop[may] + period[may]])
    long = stop - first >= np.maximum(period, LEAST - period)
    first, stop, period = first[long], stop[long], period[long]
    if not len(first):
        return _NONE
    smallest, rest, shorter = _smallest_factor(high), period.copy(), np.zeros(len(period), bool)
    while (open_ := np.flatnonzero((rest > 1) & ~shorter)).size:
        prime = smallest[rest[open_]]
        rest[open_] //= prime
        p, q, a = period[open_] // prime, period[open_], first[open_]
        shorter[open_] = _agree(hashes, level, at, a, a + p, q - p)
    return np.stack([period[~shorter], at + first[~shorter], at + stop[~shorter]])


def _agree(hashes: list[np.ndarray], level: int, at: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n words from a on equal those from b on."""
    out, left = np.ones(len(a), bool), n.copy()
    a, b = at + a, at + b
    for j in range(level, -1, -1):
        k, h = 1 << j, hashes[j]
        while (may := np.flatnonzero(out & (left >= k))).size:
            out[may] = h[a[may]] == h[b[may]]
            a[may] += k
            b[may] += k
            left[may] -= k
    return out


def fragments(words: np.ndarray) -> np.ndarray:
    """Fragments of all tiles of a text, given a hash of each word."""
    n = len(words)
    top = max((b for _, _, b, _ in octaves(n)), default=0)
    if not top:
        return _NONE
    hashes = levels(words, top)
    return np.concatenate([solved(hashes, *tile) for tile in tiles(n)], axis=1)


def _word_numbers(words: list[bytes]) -> np.ndarray:
    """A hash of each word, alike within a process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(U)


def _listed(found: list[np.ndarray | None]) -> pa.Array:
    """Arrays of (period, first, stop) as lists of structs; None is null."""
    ends = np.cumsum([0, *(0 if x is None else x.shape[1] for x in found)])
    flat = np.concatenate([x for x in found if x is not None] or [_NONE], axis=1)
    values = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["period", "first", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in found]))


def _tiled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, h (hash of the text), n_words, words (joined by a space), found (its fragments; null without any), tile (null); and
    for each tile of a long text id, h, tile (low, begin, end, hashes of its words) and nulls."""
    kind = docs.schema[id_col].dataType
    tile = T.StructType([*(T.StructField(c, T.LongType()) for c in ("low", "begin", "end")), T.StructField("words", T.BinaryType())])
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.StringType()), T.StructField("found", _FRAGMENTS), T.StructField("tile", tile)])
    to_arrow = pa.struct([("low", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("words", pa.binary())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1000, 4 << 20):
                texts = [(t or b"").split() for t in part.column(2).cast(pa.binary()).to_pylist()]
                found: list = []
                for i, words in enumerate(texts):
                    if len(words) <= LONG:
                        own = fragments(_word_numbers(words))
                        found.append(own if own.shape[1] else None)
                        continue
                    found.append(_NONE)  # may have runs: its tiles say
                    numbers = _word_numbers(words)
                    for low, a, b in tiles(len(words)):
                        rest = [pa.nulls(1, t) for t in (pa.int64(), pa.string())]
                        one = pa.array([{"low": low, "begin": a, "end": b, "words": numbers[a:b].tobytes()}], to_arrow)
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), part.column(1).slice(i, 1), *rest, _listed([None]), one], schema.names)
                joined = pa.array([b" ".join(w) for w in texts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(w) for w in texts], pa.int64()), joined, _listed(found), pa.nulls(len(texts), to_arrow)], schema.names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(explode, schema)


def _of_dealt_tiles(tiled: DataFrame) -> DataFrame:
    """Fragments (id, h, found) of the tiles of long texts, solved by other tasks than the one that cut them."""
    kind = tiled.schema["id"].dataType

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                low, a, b, raw = part.column(2)[0].as_py().values()
                own = np.frombuffer(raw, U)
                found = solved(levels(own, max(4, low // 2)), low, 0, len(own))
                found[1:] += a
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _listed([found])], ["id", "h", "found"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("found", _FRAGMENTS)])
    dealt = tiled.where("tile is not null").select("id", "h", "tile")
    return dealt.repartition(F.xxhash64("h", "tile.low", "tile.begin")).mapInArrow(solve, schema)


def _stitched(found: DataFrame) -> DataFrame:
    """(id, h, runs): fragments of each document and period that meet are one run; the runs of a document, in order."""
    parts = found.select("id", "h", F.explode("found").alias("f")).select("id", "h", "f.*").distinct()
    order = Window.partitionBy("id", "h", "period").orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = parts.withColumn("opens", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    islands = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("id", "h", "period", "run").agg(F.min("first").alias("start"), F.max("stop").alias("stop"))
    run = F.struct("start", "period", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
    return runs.groupBy("id", "h").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts from words what follows the first period of a run."""
    for batch in batches:
        for part in slices(batch, 1000, 4 << 20):
            out = []
            for words, runs in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if runs:
                    own = words.split(" ")
                    change = np.zeros(len(own) + 1, np.int64)
                    for r in runs:
                        change[r["start"] + r["period"]] += 1
                        change[r["start"] + r["length"]] -= 1
                    words = " ".join([own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])
                out.append(words)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array(out, pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, runs (start, period, length; in this order) and collapsed (the words, joined by one space, without those
    that a run repeats).  Only texts with a run are shuffled."""
    tiled = materialised(_tiled(docs, id_col, text_col), "periodic-tiles", compression="zstd")
    rows = tiled.where("tile is null").drop("tile")
    scratch = Scratch(docs.sparkSession)
    runs = scratch.write(_stitched(rows.select("id", "h", "found").union(_of_dealt_tiles(tiled))), "periodic-runs")
    none = F.array().cast(T.ArrayType(_RUN))
    plain = rows.where("found is null").select("id", "n_words", none.alias("runs"), F.col("words").alias("collapsed"))
    named = runs.select(F.col("id").alias("run_id"), F.col("h").alias("run_h"), "runs")
    some = rows.where("found is not null").join(named, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("h").eqNullSafe(F.col("run_h"))), "left")
    schema = T.StructType([tiled.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    cut = some.select("id", "n_words", "words", F.coalesce("runs", none).alias("runs")).mapInArrow(_collapse, schema)
    return plain.union(cut).select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) that the query is asked about: of every tenth id by crc32 a text whose words repeat from a place on, else the text.
    A null id leaves its text as it is.  Each step is a column of its own, so that none is worked out twice."""
    h = F.crc32(F.col(id_col).cast("string"))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.when(F.pmod(h, F.lit(10)) == 0, F.floor(h / F.lit(10)).cast("long")).alias("g"))
    worded = chosen.withColumn("words", F.when(F.col("g").isNotNull() & F.col("text").rlike(WORD), words_of(F.col("text"))))
    sized = worded.withColumn("n", F.size("words").cast("long"))
    placed = sized.withColumn("a", F.expr("cast(g % n as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p as int))), 1, cast(n as int) - a))")
    return placed.select(F.col("id").alias(id_col), F.when(F.col("words").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period), and
    SHA-256 of all runs, a line each, and of the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    one = found.select("*", F.when(F.size("runs") > 0, best).alias("best"))
    return one.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
