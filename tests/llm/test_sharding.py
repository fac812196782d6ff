"""Operator 11: laws of the shards, the exact order, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import sharding as S
from lectern.llm.common import new_path


def shards_of(spark, docs, shards=S.SHARDS, **how):
    path = new_path(spark, "shards")
    S.write_shuffled(docs, path, **how)
    return S.read_shards(spark, path, shards), path


def check(rows, n, shards):
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, ())) for k in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


@pytest.mark.parametrize(("shards", "bucket_bytes"), [(24, S.BUCKET_BYTES), (24, 5000), (7, 60_000), (1, 1000)])
def test_counts_and_slots(spark, small_docs, shards, bucket_bytes):
    found, _ = shards_of(spark, small_docs, shards, bucket_bytes=bucket_bytes)
    rows = S.shard_digests(found).collect()
    want = {r.doc_id: r.text or "" for r in small_docs.collect()}
    check(rows, len(want), shards)
    for r in rows:
        raw = want.pop(r.doc_id).encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert not want


def plain_shuffle(n, seed, bucket):
    draw = np.random.Generator(np.random.PCG64([seed, bucket]))
    others = draw.integers(0, np.arange(n, 0, -1))
    out = list(range(n))
    for k in range(n - 1):
        i, j = n - 1 - k, int(others[k])
        assert 0 <= j <= i
        out[i], out[j] = out[j], out[i]
    return out


def test_order_is_the_buckets_shuffle(spark, small_docs):
    """Buckets one after another, each in the order of its rows' hashes, permuted."""
    total = small_docs.agg(F.sum(S.size_of(F.col("text")))).first()[0]
    buckets = -(-total // 40_000)
    keyed = S.scattered(small_docs, buckets, S.SEED).select("bucket", "key", "record.doc_id").collect()
    order = []
    for b in range(buckets):
        own = [r.doc_id for r in sorted((r for r in keyed if r.bucket == b), key=lambda r: r.key)]
        order += [own[i] for i in plain_shuffle(len(own), S.SEED, b)]
    found, path = shards_of(spark, small_docs, bucket_bytes=40_000)
    rows = sorted(found.collect(), key=lambda r: (r.shard, r.slot))
    assert [r.record.doc_id for r in rows] == order
    one = S.read_shards(spark, path, only=5).collect()
    assert sorted(map(str, one)) == sorted(str(r) for r in rows if r.shard == 5)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(4, 1, b).tolist()) for b in range(12_000))
    assert len(seen) == 24
    assert max(abs(n - 500) for n in seen.values()) < 110


def test_copies_spread_and_runs_agree(spark):
    """A third of all rows are one row: they go to all buckets alike; two runs, and other orders within partitions, agree."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("one text of them all").alias("text")).coalesce(2)
    scattered = S.scattered(docs, 10, 3)
    counts = [r.n for r in scattered.where("record.doc_id = 7").groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 10 and min(counts) > 50 and max(counts) < 160
    again = S.scattered(docs.sortWithinPartitions(F.desc("doc_id")), 10, 3)
    keys = lambda df: sorted(map(tuple, df.select("bucket", "key", "record.doc_id").collect()))
    assert keys(scattered) == keys(again)


def test_odd_rows(spark, odd_docs, empty_docs):
    odd = odd_docs.withColumns({c: F.lit("extra") for c in ("bucket", "place", "record", "slot", "p")}).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    found, _ = shards_of(spark, odd.union(odd), bucket_bytes=2000)
    rows = found.collect()
    check(rows, 2 * odd.count(), 24)
    assert rows[0].record.asDict().keys() == set(odd.columns)
    assert Counter(r.record.text for r in rows) == Counter({t: 2 * n for t, n in Counter(r.text for r in odd.collect()).items()})
    digests = S.shard_digests(found).collect()
    assert {(r["size"], r.text_crc32) for r in digests if r["size"] == 8} == {(8, 0)}
    empty, _ = shards_of(spark, empty_docs)
    assert S.shard_digests(empty).collect() == []
