"""Operator 9: packing by lexical retrieval.

Documents are put in an order of like content and cut into shards of about ``SHARD_DOCS`` documents.  Document frequencies and
the mean length are counted over the whole corpus.  A document's BM25 weights are summed, with signs, into ``AXES`` sums by a
hash of the term (a count sketch, which keeps cosines).  The order is by two codes of the sketch:

* the leaf of a binary tree, grown on a sample of at most ``SAMPLE`` documents: a node is cut across the axis between its two
  means, in the widest gap of its middle, until its documents fit in a shard or ``LEAF_SAMPLE`` of the sample are left;
* within a leaf, the signs of the sketch about the sample's mean.

A range shuffle by these codes and by a number of the row puts documents of like content side by side in any corpus, with nothing
but the tree on the driver, and no key has more rows than a task may hold: equal documents are many ranges.  Each task cuts its
ordered rows into shards, at the ends of leaves where it can.  A neighbour that a cut parts from its seed is not found, and a larger
corpus has more cuts (README: recall at two sizes).

A shard has a BM25 inverted index over its documents' token ids, with the corpus's frequencies.  A seed document opens a window; the
index ranks the unused documents by their BM25 score for the seed's terms, and they fill the window in that order.  The document that
meets the window's end is cut there; its rest opens the next window and is the next seed.  The last window of a shard is
cut into lengths that are powers of two, which need no padding.

Every id of every document lies in exactly one piece.  A task holds one shard, of ``SHARD_IDS`` ids or one document at most.

Edge cases: a null or empty text is packed as its end id alone; repeated rows are packed each; null ids keep their rows;
a document longer than a window fills windows of its own and its rest is packed with others; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import materialised, slices, tidy
from lectern.llm.hashing import U, mixed
from lectern.llm.word_ids import BATCH_ROWS, BLOCK, binary_ids, word_ids

WINDOW, SHARD_DOCS, SHARD_IDS, K1, B = 4096, 512, 4 << 20, 1.2, 0.75
AXES, SAMPLE, LEAF_SAMPLE = 128, 16_384, 8
RANGE_BYTES = 16 << 20


class Corpus:
    """Number of documents, mean length and the document frequency of each term, over the whole corpus."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.n, self.mean = n, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        draw = mixed(np.arange(1, len(df) + 1, dtype=U))
        self.axis, self.sign = (draw % U(AXES)).astype(np.int64), np.where(draw >> U(63), 1, -1).astype(np.float32)

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(1.0, self.mean)))

    def sketches(self, ids: pa.Array, width: int) -> np.ndarray:
        """Unit vectors (documents, AXES) of the BM25 weights."""
        doc, term, tf, length = postings(*flat(ids, width))
        weight = self.weights(doc, term, tf, length) * self.sign[term]
        out = np.bincount(doc * AXES + self.axis[term], weight, len(length) * AXES).reshape(-1, AXES).astype(np.float32)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-9)[:, None]


def flat(ids: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the length of each document, from an Arrow binary of integers of so many bytes."""
    _, ends, data = ids.buffers()
    at = np.frombuffer(ends, np.int32, len(ids) + 1, ids.offset * 4)
    kind = f"<u{width}"
    return np.frombuffer(data, kind, (at[-1] - at[0]) // width, at[0]) if data is not None else np.empty(0, kind), np.diff(at).astype(np.int64) // width


def width_of(names: list[str]) -> int:
    """Bytes of an id in rows with these columns: ids of vocabularies up to 65,536 tokens travel in two (``ids2``), others in four."""
    return 2 if "ids2" in names else 4


def postings(ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of each posting, by document, and the documents' lengths."""
    wide = np.uint64 if len(length) > 1 << 16 or (len(ids) and int(ids.max()) >> 16) else np.uint32
    bits = wide(32 if wide is np.uint64 else 16)
    both = np.repeat(np.arange(len(length), dtype=wide) << bits, length) | ids
    both.sort()
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]))
    key = both[at]
    doc = (key >> bits).astype(np.int64)
    return doc, (key - (doc.astype(wide) << bits)).astype(np.int64), np.diff(np.append(at, len(both))), length


class Tree:
    """Leaves of vectors: cuts of the sample's vectors, each of which stands for ``each`` documents."""

    def __init__(self, sample: np.ndarray, each: float, limit: int) -> None:
        axis, cut, below, above, leaves, todo = [], [], [], [], 0, [(np.arange(len(sample)), -1, False)]
        while todo:  # a branch is the number of a node, or -1 - the number of a leaf; leaves are numbered from below
            rows, parent, side = todo.pop()
            found = self._cut(sample[rows]) if len(rows) * each > limit and len(rows) > LEAF_SAMPLE else None
            if found is None:
                name, leaves = -1 - leaves, leaves + 1
            else:
                name = len(axis)
                axis.append(found[0])
                cut.append(found[1])
                below.append(0)
                above.append(0)
                high = (sample[rows] * found[0]).sum(axis=1) > found[1]
                todo += [(rows[high], name, True), (rows[~high], name, False)]
            if parent >= 0:
                (above if side else below)[parent] = name
        self.axis, self.cut = np.array(axis, np.float32).reshape(-1, AXES), np.array(cut, np.float32)
        self.branch, self.leaves = np.array([below, above], np.int64), leaves
        self.middle = sample.mean(axis=0) if len(sample) else np.zeros(AXES, np.float32)

    @staticmethod
    def _cut(x: np.ndarray) -> tuple[np.ndarray, np.float32] | None:
        """The axis between the two means, and the widest gap in the middle half; None where all are equal."""
        a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
        for _ in range(6):
            near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
        axis = a - b
        at = np.sort((x * axis).sum(axis=1))
        gap = np.diff(at)
        middle = gap[len(at) // 4 : max(len(at) // 4 + 1, 3 * len(at) // 4)]
        k = len(at) // 4 + int(np.argmax(middle)) if len(middle) and middle.max() > 1e-6 else int(np.argmax(gap)) if len(gap) else -1
        return (axis, np.float32((at[k] + at[k + 1]) / 2)) if k >= 0 and gap[k] > 1e-6 else None

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf, and the signs about the sample's mean as the bits of a number."""
        node = np.full(len(vectors), 0 if len(self.cut) else -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            high = (vectors[open_] * self.axis[at]).sum(axis=1) > self.cut[at]
            node[open_] = self.branch[high.astype(np.int64), at]
        signs = (vectors > self.middle)[:, :62].astype(np.int64)
        return -1 - node, (signs << np.arange(61, -1, -1)).sum(axis=1)


class Index:
    """BM25 postings of one shard: documents by term, with the weight of each posting."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, corpus: Corpus) -> None:
        doc, term, tf, length = postings(ids, length)
        order = np.argsort(term, kind="stable")
        terms, at, df = np.unique(term[order], return_index=True, return_counts=True)
        self.n, self.doc, self.weight = len(length), doc[order], corpus.weights(doc, term, tf, length)[order]
        self.starts, self.ends = at, at + df
        self.rank = np.searchsorted(terms, term)
        self.first = np.searchsorted(doc, np.arange(len(length) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for the seed's distinct terms."""
        terms = self.rank[self.first[seed] : self.first[seed + 1]]
        starts, sizes = self.starts[terms], self.ends[terms] - self.starts[terms]
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(lengths: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset)."""
    pieces: list[tuple[int, int, int, int, int]] = []
    unused, sequence, room, seed, first = np.ones(len(lengths), bool), 0, window, -1, 0

    def place(doc: int, start: int) -> int:
        """Put what fits of the document's rest; the start of what is left, or -1."""
        nonlocal sequence, room
        n = min(room, int(lengths[doc]) - start)
        pieces.append((doc, start, n, sequence, window - room))
        room -= n
        if not room:
            sequence, room = sequence + 1, window
        return start + n if start + n < lengths[doc] else -1

    while True:
        if seed < 0:
            while first < len(unused) and not unused[first]:
                first += 1
            if first == len(unused):
                return pieces
            seed, left = first, 0
            unused[seed] = False
        while left >= 0:  # whole windows, then the rest
            left = place(seed, left)
        free = np.flatnonzero(unused)
        ranked = free[np.argsort(-index.scores(seed)[free], kind="stable")] if room < window and len(free) else []
        opened, seed = sequence, -1
        for doc in ranked:
            unused[doc] = False
            left = place(int(doc), 0)
            if left >= 0:
                seed = int(doc)
                break
            if sequence != opened:
                break


def even_tail(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Cut an unfilled last window into sequences whose lengths are powers of two."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    total = sum(p[2] for p in pieces if p[3] == last)
    if total == window or total & (total - 1) == 0:
        return pieces
    out, sequence, size, used = [p for p in pieces if p[3] != last], last, 1 << (total.bit_length() - 1), 0
    for doc, start, length, *_ in (p for p in pieces if p[3] == last):
        while length:
            n = min(length, size - used)
            out.append((doc, start, n, sequence, used))
            start, length, used, total = start + n, length - n, used + n, total - n
            if used == size and total:
                sequence, size, used = sequence + 1, 1 << (total.bit_length() - 1), 0
    return out


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, ids2 or ids4) of each row, written once: row tells the rows apart."""
    width = 2 if max(word_ids(tokenizer).highest, end_id) < 1 << 16 else 4
    name = f"ids{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, BATCH_ROWS, BLOCK):
                ids = binary_ids(*word_ids(tokenizer).encode(part.column(1).to_pylist(), end_id), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(row + np.arange(len(ids))), ids], ["id", "row", name])
                row += len(ids)

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField(name, T.BinaryType())])
    return materialised(read.mapInArrow(tidy(encode), schema), "packing-ids")


def corpus_of(rows: DataFrame) -> Corpus:
    """Counted over all rows; the driver gets one row for each term of the vocabulary."""

    width = width_of(rows.columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, BATCH_ROWS, BLOCK):
                _, term, _, length = postings(*flat(part.column(0), width))
                more = np.bincount(term, minlength=len(df))
                more[: len(df)] += df
                df, n, total = more, n + len(length), total + int(length.sum())
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[n, total], df[term]]))], ["term", "n"])

    found = rows.select(f"ids{width}").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    number = dict(zip(found["term"].tolist(), found["n"].tolist(), strict=True))
    n, total = number.pop(-2, 0), number.pop(-1, 0)
    df = np.zeros(max(number, default=-1) + 1, np.int64)
    df[list(number)] = list(number.values())
    return Corpus(n, total / max(1, n), df)


def tree_of(rows: DataFrame, corpus: Corpus, shard_docs: int) -> Tree:
    """Grown on a sample, by a hash, of ``SAMPLE`` rows at most."""
    share = min(1.0, 0.9 * SAMPLE / max(1, corpus.n))
    held, width = rows.sparkSession.sparkContext.broadcast(corpus), width_of(rows.columns)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH_ROWS, BLOCK):
                vectors = held.value.sketches(part.column(1), width).astype("<f2")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in vectors], pa.binary())], ["row", "vector"])

    some = rows if share == 1 else rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.select("row", f"ids{width}").mapInArrow(project, "row long, vector binary").limit(SAMPLE).toPandas().sort_values("row")
    vectors = np.frombuffer(b"".join(sample["vector"]), "<f2").reshape(-1, AXES).astype(np.float32)
    return Tree(vectors, corpus.n / max(1, len(vectors)), shard_docs)


def ordered(rows: DataFrame, corpus: Corpus, tree: Tree) -> DataFrame:
    """(leaf, code, row, id, ids2 or ids4), in ranges of like content, as many as have about ``RANGE_BYTES`` each."""
    held, width = rows.sparkSession.sparkContext.broadcast((corpus, tree)), width_of(rows.columns)
    ranges = max(1, int(corpus.n * corpus.mean * width) // RANGE_BYTES)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BATCH_ROWS, BLOCK):
                corpus, tree = held.value
                leaf, bits = tree.codes(corpus.sketches(part.column(2), width))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(bits), part.column(1), part.column(0), part.column(2)], names)

    names = ["leaf", "code", "row", "id", f"ids{width}"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names[:3]), rows.schema["id"], rows.schema[names[4]]])
    return rows.mapInArrow(tidy(code), schema).repartitionByRange(ranges, "leaf", "code", "row").sortWithinPartitions("leaf", "code", "row")


def shards(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and token ids of each shard of ordered rows (leaf, id, ids): up to ``docs`` rows, cut at the end of a leaf where
    that leaves half of them."""
    held: list[tuple[pa.Array, pa.Array]] = []
    n, size, last = 0, 0, None

    def closed() -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))

    for batch in batches:
        leaf, length, begin = batch.column(0).to_pylist(), flat(batch.column(2), width_of(batch.schema.names))[1].tolist(), 0
        for i, (own, more) in enumerate(zip(leaf, length, strict=True)):
            if n and (n >= docs or size + more > SHARD_IDS or (own != last and 2 * n >= docs)):
                held.append((batch.column(1).slice(begin, i - begin), batch.column(2).slice(begin, i - begin)))
                yield closed()
                held, begin, n, size = [], i, 0, 0
            n, size, last = n + 1, size + more, own
        held.append((batch.column(1).slice(begin), batch.column(2).slice(begin)))
    if n:
        yield closed()


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType
    rows = encoded(docs, tokenizer, end_id, id_col, text_col)
    corpus = corpus_of(rows)
    tree = tree_of(rows, corpus, shard_docs)
    held, width = docs.sparkSession.sparkContext.broadcast(corpus), width_of(rows.columns)

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for names, raw in shards(batches, shard_docs):
            ids, lengths = flat(raw, width)
            pieces = even_tail(fill(lengths, Index(ids, lengths, held.value), window), window)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            first, data = (np.cumsum(lengths) - lengths)[doc] + start, memoryview(ids.astype("<u4")).cast("B")
            own = [data[4 * a : 4 * b].tobytes() for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(own, pa.binary()), pa.array(lengths[doc]), pa.array(number + sequence), pa.array(offset)], schema.names)
            number += int(sequence.max()) + 1

    long = [T.StructField(c, T.LongType()) for c in ("start", "length")]
    schema = T.StructType([T.StructField("id", kind), *long, T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])
    return ordered(rows, corpus, tree).select("leaf", "id", f"ids{width}").mapInArrow(tidy(pack_shards), schema).withColumnRenamed("id", id_col)


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
