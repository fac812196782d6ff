"""Operator 13 against plain loops."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import periodic_runs as R


def plain_runs(words):
    """Runs by the definition: for each period stretches of equal places, without those that a shorter period explains."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                piece = words[i : i + length]
                if not any(all(piece[k] == piece[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    h, words = zlib.crc32(str(doc_id).encode()), (text or "").encode().split()
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return [w.decode() for w in words]


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def stitched(found):
    """Runs of the fragments of a text."""
    out = {}
    for q, a, b in sorted(map(tuple, found.T.tolist())):
        runs = out.setdefault(q, [])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return sorted(((a, b - a + q, q) for q, runs in out.items() for a, b in runs), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=40), st.integers(1, 9)), max_size=6))
def test_runs_of_any_text(parts):
    words = [c for piece, times in parts for c in piece * times]
    assert stitched(R.fragments(R._word_numbers([w.encode() for w in words]))) == plain_runs(words)


@pytest.mark.parametrize("tile", [32, 64])
def test_small_tiles_are_stitched(monkeypatch, tile):
    monkeypatch.setattr(R, "TILE", tile)
    draw = np.random.default_rng(5)
    for _ in range(150):
        words = []
        while len(words) < 500:
            piece = draw.integers(0, 5, draw.integers(1, 60)).tolist()
            words += piece * int(draw.choice([1, 1, 2, 3, 8]))
        assert stitched(R.fragments(R._word_numbers([b"%d" % w for w in words]))) == plain_runs(words)


def test_hashes_tell_doubling_words_apart():
    """The sequence of even and odd numbers of ones, on which sums of powers of an odd base collide."""
    words = [b"%d" % (bin(i).count("1") % 2) for i in range(1 << 12)]
    short = stitched(R.fragments(R._word_numbers(words[:600])))
    assert short == plain_runs(words[:600])
    assert all(q * 2 <= n for _, n, q in stitched(R.fragments(R._word_numbers(words))))


def test_query_equals_plain_loops(spark, small_docs, odd_docs):
    short = small_docs.where(F.length("text") < 6000)
    for docs in (short, odd_docs.where("length(text) < 4000 or text is null")):
        rows = R.run_digests(R.periodic_runs(R.planted(docs))).collect()
        want = sorted(plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert sorted(map(tuple, rows), key=lambda r: r[0]) == want


def test_long_texts_deal_out_their_tiles(spark, monkeypatch):
    words = [f"w{i % 97}" for i in range(5000)] + [f"x{i}" for i in range(3000)] + ["same"] * 5000
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short text")], "doc_id long, text string")
    want = [tuple(x) for x in R.periodic_runs(docs).orderBy("doc_id").collect()]
    assert [(r.start, r.period, r.length) for r in want[0][2]] == [(0, 97, 5000), (8000, 1, 5000)]
    monkeypatch.setattr(R, "LONG", 3000)
    assert [tuple(x) for x in R.periodic_runs(docs).orderBy("doc_id").collect()] == want
    assert want[0][3] == " ".join(words[:97] + words[5000:8001])


def test_odd_rows(spark, empty_docs):
    assert R.periodic_runs(empty_docs).collect() == []
    text = "a b c " * 8
    rows = [(1, text), (1, text), (1, "other words"), (None, text), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x")).withColumn("h", F.lit("x")).withColumn("runs", F.lit("x"))
    out = R.periodic_runs(docs).collect()
    found = sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in out)
    assert found == [(0, 0, 0, ""), (0, 24, 1, "a b c"), (1, 2, 0, "other words"), (1, 24, 1, "a b c"), (1, 24, 1, "a b c"), (2, 0, 0, "")]
