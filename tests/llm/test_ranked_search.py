"""Operator 12 against plain scores of all documents."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ranked_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """(item, rank, id, score) by scoring every document for every item."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, size in counts:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r) for r in S.ranked(docs, items, **how).collect()), key=str)


def pairs(frame, key):
    return [tuple(r) for r in frame.select(key, "text").collect()]


def test_equals_plain_scores(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert found(small_docs, items) == plain(pairs(small_docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize(("top", "task_docs", "block"), [(3, 10, 7), (50, 16, 16), (1, 1000, 64)])
def test_small_blocks_and_tasks(spark, monkeypatch, top, task_docs, block):
    """Many tasks and blocks, ties by copies, items in several blocks."""
    monkeypatch.setattr(S, "TASK_DOCS", task_docs)
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    monkeypatch.setattr(S, "FIRST", 4)
    monkeypatch.setattr(S, "ITEM_BYTES", 300)
    draw = np.random.default_rng(top)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.5, draw.integers(1, 40)) % 50) for _ in range(120)]
    docs = [(int(i), texts[int(draw.integers(0, 60))]) for i in draw.permutation(200)]
    items = [(k, " ".join(f"w{x}" for x in draw.integers(0, 60, 90 if k % 5 == 0 else 6))) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert found(frame, spark.createDataFrame(items, "item_id long, text string"), top=top) == plain(docs, items, top)


def test_masks_are_left_out_only_safely():
    """Rows that may rank hold all of the best, and not all rows are scored."""
    draw = np.random.default_rng(3)
    for _ in range(50):
        tf = draw.integers(0, 3, (500, 12)) * (draw.random((500, 12)) < 0.2)
        m, weights = draw.integers(50, 400, 500), draw.integers(0, 9000, 12)
        scores = (weights * S.impact(tf, m[:, None])).sum(axis=1)
        rows, got = S.evaluated(tf, m, weights, 1, 20)
        assert (scores[rows] == got).all()
        bound = max(1, np.sort(scores)[-20])
        assert set(np.flatnonzero(scores >= bound)) == set(rows.tolist())


def test_odd_rows(spark, odd_docs, empty_docs):
    items = [(1, "word the long same"), (1, "text"), (2, None), (None, "Émile ÀÉÎ café"), (3, "?!"), (4, "nowhere"), (5, "")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)).withColumn("rank", F.lit(1))
    docs = odd_docs.union(odd_docs.withColumn("doc_id", F.lit(None).cast("long")))
    got = found(docs, frame)
    assert got == plain(pairs(docs, "doc_id"), items)
    assert {r[0] for r in got} == {1, None}
    assert found(empty_docs, frame) == [] and found(docs, frame.where("false")) == []
    assert found(docs, frame.where("item_id in (2, 3, 5)")) == []


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    rows = S.ranked(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, rows)) == sorted(duck.execute(S.oracle_sql()).fetchall())
