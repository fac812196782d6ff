"""Sentences, folding and searches on fixtures."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import annotations as J
from lectern.operators import identity as G
from lectern.operators import language as E
from lectern.operators import text as T

SENTENCES = {
    "Dr. Smith went to the store. He bought milk.": 2,
    "J. K. Rowling wrote books. She is famous.": 2,
    "The U.S. is a country. It has many states.": 2,
    "Really?! Yes, really.": 2,
    "": 0,
    "   ": 0,
    "No mark at all": 1,
    "He came, etc. and left.": 1,
    "He came, etc. Then he left.": 2,
    'She said "Stop." Then she left': 2,
    "Wait... what?": 2,
    ". . .": 3,
    "Mr. and Mrs. Jones e.g. the old ones came. Fine!": 2,
}


def test_sentences(spark):
    texts = [*SENTENCES, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: r.n for r in docs.select("doc_id", E.sentence_count(docs.text).alias("n")).collect()}
    assert counts == {i: SENTENCES.get(t, 0) for i, t in enumerate(texts)}
    rows = E.sentences(docs).collect()
    assert [r.text for r in rows if r.doc_id == 0] == ["Dr. Smith went to the store.", "He bought milk."]
    assert {i: sum(r.doc_id == i for r in rows) for i in counts} == counts


def test_sentence_rows_and_counts_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(["a.b.c. D", "x. .y", "U.S.A. is", "etc.etc. Etc", '"Hi." "no."', "I. am. X.", "Dr . No", "é. à! ù?»  z"])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    rows = E.sentences(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {r.doc_id: r.n for r in docs.select("doc_id", E.sentence_count(docs.text).alias("n")).where("n > 0").collect()}


def test_search_folds_and_cleans(spark):
    docs = spark.createDataFrame([(1, "The Café, über-all; CAFÉ! of (the) end"), (2, None), (3, ""), (4, "cafe\u0301 of\nthe")], "doc_id long, text string")
    rows = T.phrase_matches(docs, ["cafe", "Of the", "  ", "Über"]).collect()
    assert sorted((r.doc_id, r.phrase, r.start_word, r.end_word) for r in rows) == [(1, "Of the", 4, 5), (1, "cafe", 1, 1), (1, "cafe", 3, 3), (1, "Über", 2, 2), (4, "Of the", 1, 2), (4, "cafe", 0, 0)]
    assert T.phrase_matches(docs, ["", " "]).collect() == []


def test_hashes_take_utf16_units(spark):
    """What a library in JavaScript computes: an emoji is two units."""

    def units(text):
        raw = text.encode("utf-16-le")
        return [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]

    def int32(x):
        return (x + 2**31) % 2**32 - 2**31

    def base36(n):
        return ("" if n < 36 else base36(n // 36)) + "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36]

    for text in ("ab", "é😀x", "𝒳" * 40, "plain words"):
        h, one, two = 0, 5381, 52711
        for c in units(text):
            h, one, two = int32(h * 31 + c), int32(one * 33) ^ c, int32(two * 33) ^ c
        row = spark.range(1).select(G.string_hash(F.lit(text)).alias("a"), G.text_hash(F.lit(text)).alias("b")).first()
        assert (row.a, row.b) == (base36(abs(h)), format(abs(one) * 4096 + abs(two), "016x"))


def plain_sentences(text):
    """E1 by looking at the whole sentence before each mark."""
    import re

    pieces = [(m.start(1), m.end(1), m.end()) for m in re.finditer(r"""([^.!?]*)([.!?]+["'»]?\s*)""", text)]
    out, begin = [], 0
    for k, (_, at, end) in enumerate(pieces):
        word = (text[begin:at].split() or [""])[-1]
        following = text[end : pieces[k + 1][1]] if k + 1 < len(pieces) else text[end:]
        goes_on = re.fullmatch(r"[A-Z]\.?", word) or word.lower().removesuffix(".") in E.TITLES or re.match(r"\s*[a-z]", following)
        if not (word and E._is_short(word) and goes_on):
            out.append(text[begin:end])
            begin = end
    return [s.strip() for s in (*out, text[begin:]) if s.strip()]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["Dr", "U", "S", "e", "g", "etc", "word", "Word", "A", ".", ".", ". ", "!", '."', " ", "  ", "\n", "?", "» "]), max_size=25).map("".join))
def test_sentences_of_any_text(text):
    assert E.split_sentences(text) == plain_sentences(text)


def test_sentences_take_linear_time():
    for text, most in (("no mark " * 125_000, 1), ("x" * 1_000_000, 1), ("One. Two! " * 100_000, 10), ("etc. and " * 100_000, 10), ("a . " * 250_000, 10)):
        began = time.time()
        E.split_sentences(text)
        assert time.time() - began < most


def test_positions_with_repeated_ids(spark):
    rows = [("d", "same", c, 1, 2, n, f) for c in ("pink", "blue") for n in (None, "x") for f in (True, False)]
    notes = spark.createDataFrame(rows, "doc_key string, id string, color string, start_block long, start_word long, note string, favorite boolean")
    seen = {tuple(sorted((r.id, r.line) for r in J.exported_lines(notes.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(seen) == 1 and len(next(iter(seen))) == 8
    assert sorted(r.place for r in J.positions(notes).collect()) == list(range(1, 9))
    changes = spark.createDataFrame([("same", "green", None, False), ("same", "red", "n", False), ("new", "red", None, None)], "id string, color string, note string, gone boolean")
    assert sorted(set(map(tuple, J.upserted(notes, changes).collect()))) == [("new", "red", None, "highlight"), ("same", "red", "n", "note")]


def test_sums_of_texts_agree_with_columns(spark):
    """One pass over texts and the columns of words say the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["", None, "queue area's REAL, being-rated houses churches dogs wanted rhythm Crypts aged æble", "Jeg og det er en på som øye vanligvis umulig", "x y z﻿w \x1c q", "created INTERESTING ed es ing ededes singing " * 50]
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    words = E.spelled(E.language_words(docs, "doc_id")).withColumn("complex", E.is_complex())
    want = words.groupBy("doc_id", "language").agg(F.count("word"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("syllables"))), F.lit(0)), F.count_if("complex"))
    got = E.text_sums(docs, "doc_id").select("doc_id", "language", "words", "syllables", "complex_words")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
