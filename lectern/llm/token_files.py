"""Operator 6: token ids in Parquet list columns, ordered by document, for selective reads.

A file holds a range of ids in ascending order: ``shard`` (its place among the files), the id, ``start_in_shard`` (ids of
the documents before it in the file), ``n_tokens`` and ``ids`` (list of int).  Ids are dictionary-encoded, the other
columns delta-encoded; row groups and pages have fixed sizes, and the page index of each column lets a reader fetch some
documents, or the metadata alone, without the other pages.

Edge cases: a null text counts as empty and keeps only the end id; rows with equal ids follow one another in the order of
their texts' hashes; null ids come first; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices
from lectern.llm.word_ids import BATCH_ROWS, BLOCK, word_ids

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1000
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text, append ``end_id`` and write the files to ``path``."""
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, BATCH_ROWS, BLOCK):
                first, ids = word_ids(tokenizer).encode(part.column(1).to_pylist(), end_id)
                starts = pa.array(start + first[:-1])
                start += int(first[-1])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, shard, np.int32)), part.column(0), starts, pa.array(np.diff(first)), lists], ["shard", id_col, "start_in_shard", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(id_col, kind), T.StructField("start_in_shard", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    read = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = read.repartitionByRange(id_col, "h").sortWithinPartitions(id_col, "h").select(id_col, "text")
    ordered.mapInArrow(encode, schema).write.options(**FORMAT).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Metadata without ids: shard, id, n_tokens and start (ids of all documents before it), from the metadata columns alone."""
    files = spark.read.parquet(path).drop("ids")
    return _started(files)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All of token_index and ids. A filter on the id column reaches the row groups and pages."""
    return _started(spark.read.parquet(path))


def _started(files: DataFrame) -> DataFrame:
    """Adds the start of each file, a sum over one row for each file."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    return files.join(base, "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base", "start_in_shard")


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens and the CRC-32 of its ids as little-endian 32-bit integers."""
    files = spark.read.parquet(path)
    kind = files.schema[id_col].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", id_col, "start_in_shard", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("start_in_shard", "n_tokens", "ids_crc32"))])
    read = files.select("shard", id_col, "start_in_shard", "ids").mapInArrow(digest, schema)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    return read.join(base, "shard").select(id_col, (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
