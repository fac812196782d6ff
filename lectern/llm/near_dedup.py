"""Operator 7: near duplicates by MinHash, banding, verification and connected components.

1. A document's set is its distinct 5-word shingles, as 64-bit hashes.  Documents with equal sets form a class, found by
   a digest of the set; the smallest id stands for the class from here on, so copies are never compared.
2. 128 universal hash minima of the set, in 32 bands of 4.  A pair of similarity 0.75 shares no band with probability
   5e-6.
3. Members of a bucket are compared by signatures of 512 further minima, one byte each, in tasks that hold two blocks of
   the bucket at most.  A pair counts in its first common band alone.  A task returns a spanning forest of its pairs
   that pass the estimate (four standard errors below the threshold), the most similar first, so its rows grow with the
   members and not with their square.  The forest's pairs pass the exact test on the full sets; the links make components.
4. Where a bucket still holds several components, all its pairs across components that pass the estimate are tested
   exactly, so no link between components is lost, and pairs inside a component need no test.
5. Components by alternating large-star and small-star.

Comparing signatures is quadratic in the distinct near copies of one bucket, a byte comparison each and dealt over tasks
by blocks.  A bucket of up to ``BLOCK`` distinct members shuffles each of them once; a larger one of n members shuffles each
n / ``BLOCK`` times, so a crowd of a million distinct near copies (exact ones are one member) would be a thousand million rows.
Rows that are returned grow with the members, but for pairs across components.

Edge cases: null and empty texts and texts without a word have an empty set and are linked with nothing; fewer words than
a shingle make one shingle, the whole sequence; repeated rows each get the same class; of rows with one id and different
texts each keeps the class of its own text, and the id stands for one of these texts; rows with a null id are linked with
nothing, get a null component and are kept; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Scratch, materialised, shared_dir, slices, tidy
from lectern.llm.hashing import U, shingles, word_hashes

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 75, 32, 4
MINIMA = BANDS * ROWS
#: Minima of a signature, and the least share of equal ones that is tested exactly. Members of a block of a bucket.
SIGNATURE = 512
ESTIMATE = THRESHOLD / 100 - 4 * (0.75 * 0.25 / SIGNATURE) ** 0.5
BLOCK = 1024
#: Bits of the filter that picks out the documents of step 3; its size is fixed, and a false positive costs time only.
FILTER_BITS = 1 << 22
_draw = np.random.default_rng(20_240_101)
_A = _draw.integers(0, 1 << 63, MINIMA + SIGNATURE, dtype=U) * U(2) + U(1)
_B = _draw.integers(0, 1 << 63, MINIMA + SIGNATURE, dtype=U) * U(2)
SLICE_BYTES = 1 << 20


def minima(hashes: np.ndarray, starts: np.ndarray, first: int = 0, count: int = MINIMA) -> np.ndarray:
    """``count`` minima (32 bits each), from number ``first`` on, of each run of hashes; no run is empty."""
    out = np.empty((len(starts), count), np.uint32)
    for lo in range(0, len(starts), 64):  # so that the hashes stay in the cache
        own = starts[lo : lo + 64]
        end = starts[lo + 64] if lo + 64 < len(starts) else len(hashes)
        part = hashes[own[0] : end]
        for j in range(count):
            low = np.minimum.reduceat(part * _A[first + j] + _B[first + j], own - own[0])
            out[lo : lo + 64, j] = (low >> U(32)).astype(np.uint32)
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    words, _, _, first = word_hashes(texts)
    hashes, at = shingles(words, first, SHINGLE)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each band of each set; no set is empty."""
    size = np.array([len(x) for x in sets], np.int64)
    wide = minima(np.concatenate(sets), np.cumsum(size) - size).astype(U).reshape(len(sets), BANDS, ROWS)
    key = np.zeros((len(sets), BANDS), U)
    for r in range(ROWS):
        key = (key ^ wide[:, :, r]) * U(0x9E3779B97F4A7C15)
        key ^= key >> U(29)
    return (key + np.arange(1, BANDS + 1, dtype=U) * U(0xD1B54A32D192ED03)).view(np.int64)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, n_shingles, digest of the set and a key for each band; the last two null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1000, SLICE_BYTES):
                sets = shingle_sets(part.column(1))
                full = [i for i, x in enumerate(sets) if len(x)]
                bands: list = [None] * len(sets)
                for i, keys in zip(full, band_keys([sets[i] for i in full]) if full else [], strict=True):
                    bands[i] = keys
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "h", "n_shingles", "digest", "bands"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(tidy(sign), schema)


def detailed(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For the ids: id, sig (512 bytes), low halves of the band keys, and the sorted set. Texts are not shuffled: a filter of
    fixed size lets through the ids' documents, and some others, where they are read."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toArrow()  # as columns: the driver would hold a row of Python's objects for each of them
    bits = np.zeros(FILTER_BITS // 32, U)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(U)
    wanted = spark.sparkContext.broadcast(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((wanted.value[at >> 5] >> (at & 31).astype(U)) & U(1) == 1))
            for part in slices(batch, 1000, SLICE_BYTES):
                sets = shingle_sets(part.column(1))
                part = part.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))
                if sets := [x for x in sets if len(x)]:
                    size = np.array([len(x) for x in sets], np.int64)
                    sig = minima(np.concatenate(sets), np.cumsum(size) - size, MINIMA, SIGNATURE).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (sig, band_keys(sets).astype(np.int32), sets))], ["id", "sig", "bands", "set"])

    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.BinaryType()) for c in ("sig", "bands", "set"))])
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").withColumn("slot", slot)
    return read.mapInArrow(tidy(build), schema).join(ids, "id", "left_semi").dropDuplicates(["id"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values of the first column, in rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _forest(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> list[int]:
    """Places of the pairs that make a spanning forest, the most similar pairs first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[up]
        return x

    taken = []
    for k in np.argsort(-equal, kind="stable").tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            taken.append(k)
    return taken


def similar_pairs(members: DataFrame, details: DataFrame, across: bool) -> DataFrame:
    """Pairs (a, b) of the members (key, band, n, id, component) of each bucket that pass the estimate: a forest of them, or
    with ``across`` all whose components differ."""
    kind = members.schema["id"].dataType
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.hash("id"), blocks)
    dealt = members.select("*", blocks.alias("blocks"), mine.alias("mine")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), F.lit(2)).when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    rows = dealt.select(group.alias("group"), side.alias("side"), "band", "id", F.xxhash64("component").alias("component"))
    rows = rows.join(details.select("id", "sig", "bands"), "id").select("group", "side", "band", "component", "sig", "bands", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if t.num_rows < 2:
                continue
            side, band, comp = (t.column(k).to_numpy() for k in (1, 2, 3))
            sig = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            keys = np.frombuffer(b"".join(t.column(5).to_pylist()), np.int32).reshape(-1, BANDS)
            left = np.flatnonzero(side != 1)
            right = left if side[0] == 2 else np.flatnonzero(side == 1)
            found: list = []
            for at in range(0, len(left), 64):
                own = left[at : at + 64]
                equal = (sig[own][:, None, :] == sig[right][None, :, :]).sum(-1, dtype=np.int16)
                ok = equal >= ESTIMATE * SIGNATURE
                if side[0] == 2:
                    ok &= own[:, None] < right[None, :]
                if across:
                    ok &= comp[own][:, None] != comp[right][None, :]
                x, y = np.nonzero(ok)
                if len(x):
                    first = (keys[own[x], : band[0]] == keys[right[y], : band[0]]).any(axis=1)
                    found.append((own[x[~first]], right[y[~first]], equal[x, y][~first]))
            if found:
                a, b, equal = (np.concatenate(z) for z in zip(*found, strict=True))
                if not across:
                    taken = _forest(a, b, equal)
                    a, b = a[taken], b[taken]
                if len(a):
                    ids = t.column(6).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(tidy(compare), schema)


def verified(pairs: DataFrame, details: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets pass the exact test."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                keep = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    n, both = (len(x) + len(y)) // 8, np.sort(np.frombuffer(x + y, U))
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= THRESHOLD * (n - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = details.select("id", "set")
    tested = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    return scratch.write(tested.mapInArrow(tidy(exact), pairs.schema), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in the links (a, b); component is the smallest id that the links reach."""
    shared_dir(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable) and kept (id = component_id)."""
    return _judged(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, as they are. A row goes for its own text: rows with its id and another text stay if they are kept,
    and so do rows that repeat a kept row."""
    gone = _judged(docs, id_col, text_col).where("not kept").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    rows = docs.alias("rows")
    return rows.join(gone, (F.col(f"rows.{id_col}") == F.col("gone_id")) & (F.xxhash64(F.col(f"rows.{text_col}").cast("string")) == F.col("gone_h")), "left_anti")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n_shingles, component_id, kept)."""
    base, scratch = materialised(digests(docs, id_col, text_col), "digests"), Scratch(docs.sparkSession)
    whole = base.where("id is not null and digest is not null")
    classes = whole.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = whole.select("id", "bands").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    members = scratch.write(reps, "representatives").select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = scratch.write(members.join(buckets, "key").select("key", "band", "n", "id"), "buckets")
    details = scratch.write(detailed(docs, crowded.select("id").distinct(), id_col, text_col), "details")

    pairs = scratch.write(similar_pairs(crowded.withColumn("component", F.col("id")), details, across=False), "forest")
    links = verified(pairs, details, scratch)
    found = components(links)
    placed = crowded.where("n > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    pairs = scratch.write(similar_pairs(placed.join(split, "key", "left_semi"), details, across=True), "across")
    more = verified(pairs, details, scratch)
    if not more.isEmpty():
        found = components(links.union(more))
    scratch.clear()  # components are checkpoints; the result reads these and the digests

    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    own = base.select("id", "h", "n_shingles", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = own.join(named, "digest", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", "h", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
