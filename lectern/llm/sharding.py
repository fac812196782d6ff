"""Operator 11: rows in random order in shards of equal counts, by a shuffle of two passes.

1. Rows are scattered over buckets that fit in a task's memory, by a seeded hash of their content and of their place: each
   partition is put into the order of the contents' hashes and numbered, so that rows alike in all columns get numbers of their own and a
   partition that is computed again scatters its rows to the same buckets in whatever order they come.
2. A task takes its buckets one by one, in the order of the rows' hashes, permutes each by a Fisher-Yates shuffle seeded by the bucket,
   and writes it.  The order of all rows is bucket after bucket.
3. The law is ``rows``: with N rows, row p of this order is in shard floor(p * shards / N), so counts are one apart at most and a shard is
   a run of buckets.  What is shared is a row a bucket: its number of rows and the rows before it.

The number of buckets is the bytes of all texts over ``BUCKET_BYTES``, so a task's memory stays the same as tables grow; one row is never
cut.  Nothing is collected, no key is a group: copies of one text, however many, are dealt like other rows.

Edge cases: null texts have no bytes; empty tables give no rows; repeated rows each have a place; a row's own columns, whatever their
names, travel in one struct; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices

SHARDS, SEED, BUCKET_BYTES = 24, 20_240_229, 16 << 20
#: What a row counts beside its text.
ROW_BYTES = 8


def size_of(text: Column) -> Column:
    """Bytes of a row: of its text in UTF-8, and ``ROW_BYTES``."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Order of n rows: from the last place to the second, each changes with a place up to itself that the bucket's generator draws."""
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    order, others = list(range(n)), draw.integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, 0, -1), others, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def scattered(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(bucket, key, record): the rows with a seeded hash each and the bucket that it names."""
    # fields are taken from the struct: names may hold dots, or be names used here
    whole = docs.select(F.struct("*").alias("record"))
    fields = [F.col("record").getField(f.name) for f in docs.schema if _hashable(f.dataType)]
    content = whole.select("record", F.xxhash64(*fields).alias("content") if fields else F.lit(0).cast("long").alias("content"))
    numbered = content.sortWithinPartitions("content").select("record", F.xxhash64(F.lit(seed), "content", F.monotonically_increasing_id()).alias("key"))
    return numbered.select(F.pmod("key", F.lit(buckets)).cast("long").alias("bucket"), "key", "record")


def _permute(seed: int):
    def permuted(held: list[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, bucket)))
        place = 0
        for batch in rows.to_batches():
            for part in slices(batch, 4096, 4 << 20):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(place, place + n)), part.column(2)], ["bucket", "place", "record"])
                place += n

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != own[a]:
                    yield from permuted(held, held[0].column(0)[0].as_py())
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from permuted(held, held[0].column(0)[0].as_py())

    return permute


def write_shuffled(docs: DataFrame, path: str, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the rows, bucket by bucket in random order, to ``path``/rows (bucket, place, record), and each bucket's number of rows and
    the rows before it to ``path``/buckets."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(size_of(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-int(total) // bucket_bytes))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType()), T.StructField("record", docs.schema)])
    dealt = scattered(docs, buckets, seed).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    dealt.mapInArrow(_permute(seed), schema).write.option("compression", "zstd").parquet(f"{path}/rows")
    counts = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    counts.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).coalesce(1).write.parquet(f"{path}/buckets")


def read_shards(spark: SparkSession, path: str, shards: int = SHARDS, only: int | None = None) -> DataFrame:
    """(shard, slot, record) of the rows that ``write_shuffled`` wrote, in ``shards`` shards; of the shard ``only`` where it is given,
    whose buckets alone are read then.  Slots have no gaps."""
    rows, buckets = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    first = lambda s: -(-s * total // shards)
    if only is not None:
        inside = buckets.where((F.col("base") < first(only + 1)) & (F.col("base") + F.col("n") > first(only)))
        ends = inside.agg(F.min("bucket"), F.max("bucket")).first()
        rows = rows.where(F.col("bucket").between(*ends)) if ends[0] is not None else rows.where("false")
    placed = rows.join(buckets, "bucket").withColumn("p", F.col("base") + F.col("place"))
    shard = F.expr(f"(p * {shards}) div {max(1, total)}")
    named = placed.select(shard.cast("int").alias("shard"), "p", "record")
    out = named.select("shard", (F.col("p") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot"), "record")
    return out if only is None else out.where(F.col("shard") == only)


def shard_digests(shards: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, CRC-32 of the text, law, shard, slot and grown_shard (null: under this law one more shard moves rows)."""
    text = F.col("record").getField(text_col).cast("string")
    return shards.select(
        F.col("record").getField(id_col).alias(id_col), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
