"""Upserts, long paragraphs, late rows and labels on fixtures."""

from pyspark.sql import functions as F

from lectern.operators import exchange as X


def test_upserts(spark):
    existing = spark.createDataFrame(
        [(1, 10, "old", "a", "web", "https://www.x.org/p/?utm_source=q", None, 5, "2024-01-01", "2024-01-02"), (1, 11, "same url", None, "web", "https://x.org/p", None, None, "2024-01-01", "2024-01-02"), (1, 12, "file", None, "pdf", None, "h1", 7, "2024-01-01", "2024-01-02"), (2, 13, "other user", None, "pdf", None, "h1", 7, "2024-01-01", "2024-01-02")],
        "user_id long, id long, title string, author string, type string, url string, file_hash string, word_count long, created string, last_opened string",
    )
    inputs = spark.createDataFrame(
        [(1, "new", None, "web", "https://X.org/p#top", None, None, 1), (1, "newer", None, "web", "https://x.org/p", None, 9, 2), (1, "fresh", "b", "epub", None, "h2", 3, 1), (1, "file again", None, "pdf", None, "h1", None, 1), (1, "no key", None, "paste", None, None, None, 1)],
        "user_id long, title string, author string, type string, url string, file_hash string, word_count long, opened long",
    )
    rows = {(r.user_id, r.id): r for r in X.upserted(existing, inputs, F.lit("2024-02-01")).collect()}
    assert set(rows) == {(1, "10"), (1, "11"), (1, "12"), (2, "13"), (1, "file_epub_h2")}
    assert (rows[1, "10"].title, rows[1, "10"].author, rows[1, "10"].word_count, rows[1, "10"].created, rows[1, "10"].last_opened) == ("newer", "a", 9, "2024-01-01", "2024-02-01")
    assert (rows[1, "11"].title, rows[1, "12"].title, rows[1, "12"].word_count, rows[2, "13"].last_opened) == ("same url", "file again", 7, "2024-01-02")
    assert (rows[1, "file_epub_h2"].created, rows[1, "file_epub_h2"].title) == ("2024-02-01", "fresh")


ITEMS = "user_id long, id string, title string, author string, type string, url string, file_hash string, word_count long, created long, last_opened long, paste_content string"
INPUTS = "user_id long, title string, author string, type string, url string, file_hash string, word_count long, opened long, paste_content string"


def test_upserts_by_hash_or_url_and_pastes(spark):
    pasted = spark.range(1).select(X.text_hash(F.lit("pasted words"))).first()[0]
    existing = spark.createDataFrame([(1, "a", "by url", None, "web", "https://x.org/a", None, 1, 1, 5, None), (1, "b", "by hash", None, "pdf", None, "h1", 1, 1, 9, None), (1, "c", "old paste", None, "paste", None, None, 2, 1, 3, "pasted words"), (2, "d", "another's", None, "pdf", None, "h1", 1, 1, 1, None)], ITEMS)
    inputs = [
        (1, "new hash, known url", None, "pdf", "https://www.x.org/a", "h7", None, 20, None),  # the url finds a
        (1, "hash and url of two items", None, "pdf", "https://x.org/a", "h1", None, 21, None),  # b was opened last
        (1, "paste", None, "paste", None, None, None, 22, "pasted words"), (1, "long", None, "paste", None, None, None, 23, "y" * 150_000), (1, "nothing", None, "paste", None, None, None, 24, None),
        (3, "first", "x", "web", "https://x.org/a", "h8", None, 25, None), (3, "second", None, "web", "https://x.org/a", "h9", 4, 26, None),
    ]
    rows = sorted(map(tuple, X.upserted(existing, spark.createDataFrame(inputs[:1] + inputs[2:], INPUTS)).select("user_id", "id", "title", "file_hash", "word_count", "created", "last_opened", F.length("paste_content")).collect()))
    long = next(r[1] for r in rows if r[2] == "long")
    assert rows == sorted([
        (1, "a", "new hash, known url", "h7", 1, 1, 20, None), (1, "b", "by hash", "h1", 1, 1, 9, None), (1, "c", "paste", pasted, 2, 1, 22, 12), (2, "d", "another's", "h1", 1, 1, 1, None),
        (1, long, "long", None, None, 23, 23, 100_000), (3, "file_web_h9", "second", "h9", 4, 26, 26, None),
    ])
    assert long.startswith("paste_")
    one = X.upserted(existing, spark.createDataFrame(inputs[1:2], INPUTS))
    assert {r.id: r.title for r in one.collect()} == {"a": "by url", "b": "hash and url of two items", "c": "old paste", "d": "another's"}


def test_long_paragraphs(spark):
    sentence = "This sentence is about fifty characters in length. "
    long, plain = (sentence * 30).strip(), sentence.strip()
    rows = {r.id: r.parts for r in spark.createDataFrame([(1, long), (2, plain), (3, "x" * 1500), (4, "")], "id long, text string").select("id", X.split_paragraph(F.col("text")).alias("parts")).collect()}
    assert " ".join(rows[1]) == long and len(rows[1]) == 3 and all(450 < len(p) < 600 for p in rows[1])
    assert rows[2] == [plain] and rows[3] == ["x" * 1500] and rows[4] == [""]


def test_file_types(spark):
    names = ["a.PDF", "b.epub.zip", "c.azw3", "d.azw", "e.zip", "f", ".docx", None, "pdf"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string").select(X.file_type(F.col("name")).alias("t")).collect()
    assert [r.t for r in rows] == ["pdf", "epub", "mobi", "mobi", None, None, "docx", None, None]


def test_labels(spark):
    numbers = [0, 999, 1000, 1049, 1050, 999_999, 1_000_000, 2_550_000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select(X.large_number(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == ["0", "999", "1.0K", "1.0K", "1.1K", "1000.0K", "1.0M", "2.6M"]


def test_files_that_are_no_exports(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "[1]"), (4, "{"), (5, "null")], "file long, json string")
    assert {r.valid for r in X.stats_import_report(bad).collect()} == {False} and {r.valid for r in X.notes_import_report(bad).collect()} == {False}
