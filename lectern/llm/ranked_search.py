"""Operator 12: the best documents for each item, by presence masks.

1. Texts are cut into terms once; a table keeps, of each document, its number of terms and the items' terms in it with their counts.
   Documents with a term, their terms and the documents of each of the items' terms are summed up from it.
2. A task takes the documents of some partitions, a block at a time, and for each item groups the block's documents by the bitmap
   of the item's terms that they hold.  A mask's greatest score is that of its terms at the greatest counts in the block and the least length
   of its documents.  Masks are evaluated in falling order of it, until it is below the task's score of rank ``TOP`` for the item (it
   may not be equal: a document with the same score and a smaller id would rank higher), so nothing that could rank is left out.
3. Each task gives the ``TOP`` best of each item; of these a window over each item keeps the best.

Items come from a table that is taken in blocks of about ``ITEM_BYTES`` of text, by a hash of their ids; what a task holds, and what
is broadcast, is bounded by that, and the corpus is read once for each block.  Scoring tasks take ``TASK_DOCS`` documents at least, so that what
they give, ``TOP`` rows an item, is little beside what they read.

Terms are compared by 64-bit hashes.  Scores are 64-bit integers; 50 * terms of a text * documents must stay below 2^63.

Edge cases: null and empty texts, and texts without a term, are no documents of the search; an item without terms, or whose terms no
document has, gives no rows; rows of one item id are one item with the terms of all of them, and a null id is an id; repeated documents
each have a rank; among equal scores ids ascend and null is last; other columns are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import Scratch, materialised, slices
from lectern.llm.hashing import word_hashes

TOP, ITEM_BYTES, TASK_DOCS = 50, 1 << 20, 1 << 15
#: Cells of a block of documents times terms; documents of a block at most; documents that are scored before the first look at the bound.
CELLS, BLOCK_DOCS, FIRST = 4 << 20, 2048, 64
SLICE_BYTES = 2 << 20


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by: rises with its count in the document, falls with the document's m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents of n terms, in a corpus of so many documents and terms."""
    return 50 + (50 * n * documents) // terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of the documents with a term: places in the sorted vocabulary (32 bits each) of those that are in it, and
    how often they are in the text."""
    kind, shared = docs.schema[id_col].dataType, docs.sparkSession.sparkContext.broadcast(vocabulary)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, 2048, SLICE_BYTES):
                hashes, _, _, first = word_hashes(part.column(1), ascii_words=True)
                n = np.diff(first)
                place = np.searchsorted(known, hashes)
                place[place == len(known)] = 0
                hit = np.flatnonzero(known[place] == hashes)
                owner = np.repeat(np.arange(len(n)), n)[hit]
                code, count = np.unique(owner * len(known) + place[hit], return_counts=True)
                ends = np.searchsorted(code, np.arange(len(n) + 1) * len(known)) * 4
                raw = [x.astype("<i4").tobytes() for x in (code % len(known), count)]
                lists = [pa.array([x[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()) for x in raw]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("terms", "counts"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, schema)


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms is; each task gives its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, 4096):
                own += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), "<i4"), minlength=size)
        term = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(own[term])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a boolean matrix: the first row with each distinct bitmap, and which bitmap each row has."""
    bits = np.packbits(present, axis=1)
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, : bits.shape[1]] = bits
    masks = wide.view(np.uint64) if wide.shape[1] == 8 else wide.view(np.dtype((np.void, wide.shape[1])))
    _, first, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)
    return first, group


def evaluated(tf: np.ndarray, m: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and their scores, of a block that may rank: all whose score is above 0 and at least both ``least`` and the block's own score
    of rank ``top``."""
    present = tf > 0
    first, group = _masks(present)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, group, m)
    most = (present[first] * weights * impact(tf.max(axis=0), low[:, None])).sum(axis=1)
    order = np.argsort(-most[group], kind="stable")
    bound = most[group][order]
    rows: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    at, step, least = 0, FIRST, max(1, least)
    while at < len(order) and bound[at] >= least:
        own = order[at : min(at + step, int(np.searchsorted(-bound, -least, side="right")))]
        rows.append(own)
        scores.append((weights * impact(tf[own], m[own][:, None])).sum(axis=1))
        at, step = at + len(own), 2 * step
        so_far = np.concatenate(scores)
        if len(so_far) >= top:
            least = max(least, int(np.partition(so_far, len(so_far) - top)[len(so_far) - top]))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, got = np.concatenate(rows), np.concatenate(scores)
    keep = got >= least
    return found[keep], got[keep]


def _order(row: tuple) -> tuple:
    return -row[0], row[1] is None, row[1] if row[1] is not None else 0


def heads(found: DataFrame, items: list[tuple[object, np.ndarray]], counts: np.ndarray, documents: int, terms: int, item_kind: T.DataType, top: int) -> DataFrame:
    """(item, id, score): of each task the ``top`` best of each item (id, places of its terms)."""
    weighted = [(item, own, np.array([weight(documents, int(counts[t])) for t in own], np.int64)) for item, own in items]
    shared, kind = found.sparkSession.sparkContext.broadcast(weighted), found.schema["id"].dataType
    size = len(counts)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in shared.value]
        for batch in batches:
            for part in slices(batch, max(1, min(BLOCK_DOCS, CELLS // size)), 64 << 20):
                n, held = part.column(1).to_numpy(), part.column(2).to_pylist()
                term, count = (np.frombuffer(b"".join(x), "<i4") for x in (held, part.column(3).to_pylist()))
                tf = np.zeros((len(n), size), np.int64)
                tf[np.repeat(np.arange(len(n)), [len(x) // 4 for x in held]), term] = count
                m, ids = length_factor(n.astype(np.int64), documents, terms), part.column(0)
                for k, (_, own, weights) in enumerate(shared.value):
                    least = best[k][-1][0] if len(best[k]) == top else 1
                    rows, scores = evaluated(tf[:, own], m, weights, least, top)
                    if len(rows):
                        more = list(zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist(), strict=True))
                        best[k] = sorted(best[k] + more, key=_order)[:top]
        which = [k for k, rows in enumerate(best) for _ in rows]
        names = pa.array([shared.value[k][0] for k in which], to_arrow["item"])
        flat = [r for rows in best for r in rows]
        yield pa.RecordBatch.from_arrays([names, pa.array([r[1] for r in flat], to_arrow["id"]), pa.array([r[0] for r in flat], pa.int64())], ["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = {"item": to_arrow_type(item_kind), "id": to_arrow_type(kind)}
    return found.mapInArrow(rank, T.StructType([T.StructField("item", item_kind), T.StructField("id", kind), T.StructField("score", T.LongType())]))


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Blocks of (item id, text) of about ``ITEM_BYTES`` of text; all rows of an id are in one block."""
    text = F.col(text_col).cast("string")
    rows = items.select(F.col(item_col).alias("item"), text.alias("text")).where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-int(size) // ITEM_BYTES)
    for b in range(blocks):
        yield [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", top: int = TOP) -> DataFrame:
    """(item, rank, id, score): of each item the ``top`` documents with the highest scores above 0, equal ones by id."""
    spark, parts = docs.sparkSession, []
    item_kind, kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    for block in item_blocks(items, item_col, text_col):
        hashes, _, _, first = word_hashes(pa.array([t for _, t in block], pa.string()), ascii_words=True)
        terms_of: dict = {}
        for (item, _), a, b in zip(block, first[:-1], first[1:], strict=True):
            terms_of.setdefault(item, []).append(hashes[a:b])
        vocabulary = np.unique(hashes)
        if not len(vocabulary):
            continue
        known = [(item, np.searchsorted(vocabulary, np.unique(np.concatenate(own)))) for item, own in terms_of.items()]
        scratch = Scratch(spark)
        found = scratch.write(postings(docs, vocabulary, id_col, text_col), "postings", compression="zstd")
        sums = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        wide = found.coalesce(max(1, sums.documents // TASK_DOCS))
        if sums.documents:
            counts = document_counts(wide, len(vocabulary))
            parts.append(materialised(heads(wide, [x for x in known if len(x[1])], counts, sums.documents, int(sums.terms), item_kind, top), "search-heads"))
        scratch.clear()
    if not parts:
        parts = [spark.createDataFrame([], T.StructType([T.StructField("item", item_kind), T.StructField("id", kind), T.StructField("score", T.LongType())]))]
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def oracle_sql(top: int = TOP) -> str:
    """DuckDB SQL of the query over documents and benchmark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda table: rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from {table}"
    return f"""with t as (select doc_id, {terms("documents")}), tf as (select doc_id, term, count(*) as tf from t group by all),
lengths as (select doc_id, count(*) as n from t group by doc_id), sums as (select count(*) as docs, sum(n)::bigint as terms from lengths),
m as (select doc_id, 50 + (50 * n * docs) // terms as m from lengths, sums), df as (select term, count(*) as df from tf group by term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, sums),
q as (select distinct item_id, {terms("benchmark")}),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from q join w using (term) join tf using (term) join m using (doc_id) group by all),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= {top}"""
