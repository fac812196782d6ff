"""Steps that read each text once, where it lies, and shuffle no word of it."""

import hashlib
from random import Random

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as X
from lectern.operators import exchange, language as E, text as D
from lectern.plans import catalog

SF = "/root/testdata/sf0.001"
ODD = """"hi" 'tis x." e.g. e.g." U.S. U. U S.' Mr.» however, how,ever; —- a- «q» q» "q» » " ' ) a) ... a.. a… ?! !? ?" however however; howe:ver ab. AB. ABC. k. K. no. No.'' x.'' .. , ; : ,, don't- well-known æ-ø Œuvre 中文字 Ünï"""


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_rules_say_the_same_of_columns_and_words(spark):
    rows = E.spelled(spark.createDataFrame([(w, n) for w in ODD.split() for n in ("en", "no")], "word string, language string"))
    rules, times = E._Words(), {a: E.WordTimes(a) for a in (True, False)}
    for r in rows.select("word", "language", E.tier().alias("tier"), D.pause(F.col("word")).alias("pause"), E.word_duration(237).alias("fitted"), E.word_duration(237, False).alias("plain")).collect():
        assert (rules.tier(r.word, r.language), D.pause_of(r.word)) == (r.tier, r.pause), r.word
        if r.language == "en":
            assert (times[True].of(r.word, 237)[0], times[False].of(r.word, 237)[0]) == (r.fitted, r.plain), r.word


def test_known_words_are_few_and_may_be_forgotten(spark, monkeypatch):
    assert max(E._Words.MOST, D.PhraseFinder.MOST) <= 1 << 16
    text = " ".join(f"word{i % 37}x{'a' * (i % 5)}," for i in range(300))
    whole = E.WordTimes(True).of(text, 250).tolist()
    monkeypatch.setattr(E, "KNOWN_WORDS", 7)
    assert E.WordTimes(True).of(text, 250).tolist() == whole


@pytest.mark.parametrize("name", ["e03_dictionary_syllables", "e06_complex_words", "d12_tier_counts", "d13_token_durations"])
def test_texts_are_read_once(spark, name):
    shown = plan(catalog.QUERIES[name](spark, SF))
    assert shown.count("documents.parquet") == 1 and "MapInArrow" in shown and "SortMergeJoin" not in shown


def test_words_are_not_shuffled(spark):
    shown = plan(catalog.QUERIES["d15_word_pacing"](spark, SF))
    assert "Window" not in shown
    assert "Join" not in plan(catalog.QUERIES["f04_matches_at"](spark, SF))


def test_matches_over_words(spark):
    r = Random(3)
    some = [(d, s, s + r.randrange(4)) for d in range(20) for s in sorted(r.sample(range(40), 15))]
    found = X.matches_at(None, spark.createDataFrame(some, "doc_id long, start_word long, end_word long"))
    want = []
    for d in range(20):
        own = [m[1:] for m in some if m[0] == d]
        for w in range(50):
            if over := [(k, a) for k, (a, b) in enumerate(own) if a <= w <= b]:
                want.append((d, w, over[0][0], over[0][1] == w))
    assert sorted(map(tuple, found.collect())) == want


def test_only_the_ends_of_large_files_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "LARGE", 300_000)
    monkeypatch.setattr(exchange, "fingerprint", lambda content, length: F.when(length > 300_000, F.raise_error(F.lit("read"))).otherwise(F.lit("small")))
    data = Random(1).randbytes(300_001)
    (tmp_path / "large one").write_bytes(data)
    (tmp_path / "small").write_bytes(data[:-1])
    found = {r.length: r.file_hash for r in exchange.file_fingerprints(spark, f"file://{tmp_path}").collect()}
    assert found == {300_000: "small", 300_001: hashlib.sha256(data[:65536] + data[-65536:] + (300_001).to_bytes(8, "little")).hexdigest()[:16]}


def test_words_of_a_document_are_paced_across_batches(spark):
    blocks = spark.createDataFrame([(d, b, "paragraph", "one two three") for d in range(3) for b in range(40)], "doc_id long, block long, type string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = X.paced_words(blocks, blocks.select("doc_id", "block", F.lit(1.0).alias("wpm_factor")), 300, adaptive=False).orderBy("doc_id", "block", "unit").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.start_ms for r in rows] == [200 * k for k in range(120)] * 3
