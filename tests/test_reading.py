"""Exports of annotations, orders of titles, durations and charts on fixtures."""

import html
import json

from pyspark.sql import functions as F

from lectern.operators import annotations as J
from lectern.operators import blocks as X
from lectern.operators import language as E
from lectern.operators import library as H
from lectern.operators import stats as K

NOTES = "doc_key long, id string, text string, note string, color string, favorite boolean, tags array<string>, created date, start_block long, start_word long, title string"


def files(spark, rows, kind):
    notes = spark.createDataFrame(rows, NOTES).withColumn("created", F.lit("2024-03-05").cast("date"))
    parts = J.exported(notes.repartition(3), kind, "2024-04-01").collect()
    return {k: "\n".join(r.part for r in sorted(parts, key=lambda r: r.place) if r.doc_key == k) for k in {r.doc_key for r in parts}}


ROWS = [
    (1, "b", 'second "quoted"', "  spaced note ", "pink", True, ["x", 'y"z'], None, 2, 0, "A & B"),
    (1, "a", "first", None, "blue", None, None, None, 1, 7, "A & B"),
    (2, "c", None, " ", None, False, [], None, 1, 1, None),
]


def test_markdown_and_text(spark):
    assert files(spark, ROWS, "markdown") == {
        1: '# Highlights from "A & B"\n\n## Highlight 1\n> "first"\n\n---\n\n## Highlight 2\n> "second "quoted""\n\n**Note:** spaced note\n',
        2: '# Highlights from "Untitled"\n\n## Highlight 1\n> ""\n',
    }
    assert files(spark, ROWS, "text") == {
        1: 'Highlights from "A & B"\n\n---\n\n"first"\n\n---\n\n"second "quoted""\nNote: spaced note',
        2: 'Highlights from "Untitled"\n\n---\n\n""',
    }


def test_json_reads_back(spark):
    found = {k: json.loads(v) for k, v in files(spark, ROWS[:2] + [(2, "c", "new\nline \\ é", " ", "red", False, [], None, 1, 1, None)], "json").items()}
    assert found[1]["documentTitle"] == "A & B" and found[1]["exportedAt"] == "2024-04-01T00:00:00.000Z"
    assert found[1]["annotations"] == [
        {"text": "first", "note": None, "color": "blue", "isFavorite": False, "tags": [], "createdAt": "2024-03-05T00:00:00.000Z"},
        {"text": 'second "quoted"', "note": "  spaced note ", "color": "pink", "isFavorite": True, "tags": ["x", 'y"z'], "createdAt": "2024-03-05T00:00:00.000Z"},
    ]
    assert found[2]["annotations"][0]["text"] == "new\nline \\ é"


def test_json_of_nulls_reads_back(spark):
    assert json.loads(files(spark, ROWS, "json")[2])["annotations"][0] == {"text": "", "note": " ", "color": None, "isFavorite": False, "tags": [], "createdAt": "2024-03-05T00:00:00.000Z"}


def test_html_escapes(spark):
    page = files(spark, [(1, "a", "<i>&'", "<note>", "blue", True, None, None, 1, 1, "T<")], "html")[1]
    assert "&lt;i&gt;&amp;&#039;" in page and "<i>" not in page and "&lt;note&gt;" in page and "★" in page and "March 5, 2024" in page and "<p>1 highlight · Exported April 1, 2024</p>" in page
    assert "<i>&'" in html.unescape(page)


def test_many_notes_of_one_document(spark):
    n = 3000
    notes = spark.range(n).select(F.lit(1).cast("long").alias("doc_key"), F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("").alias("note"), F.lit("c").alias("color"), F.lit(False).alias("favorite"), F.array().cast("array<string>").alias("tags"), F.lit("2024-01-01").cast("date").alias("created"), F.col("id").alias("start_block"), F.lit(0).alias("start_word"), F.lit("x").alias("title"))
    parts = J.exported(notes, "json", "2024-04-01").orderBy("place").collect()
    assert [r.place for r in parts] == list(range(n + 2))
    assert len(json.loads("\n".join(r.part for r in parts))["annotations"]) == n


def test_copied(spark):
    rows = spark.createDataFrame([("t", " n "), ("t", "  "), (None, None)], "text string, note string")
    assert [r[0] for r in rows.select(J.copied()).collect()] == ['"t"\nNote: n', '"t"', '""']


def test_titles_in_the_order_of_a_reader(spark):
    items = spark.createDataFrame([(i, t, None if t == "b" else t) for i, t in enumerate(["b", "Éa", "a", "B", "z", "éb", "A", "f"])], "id long, title string, author string")
    assert [r.title for r in H.page(items, "title", 10).collect()] == ["a", "A", "b", "B", "Éa", "éb", "f", "z"]
    assert [r.title for r in H.page(items, "author", 10, descending=True).collect()] == ["z", "f", "éb", "Éa", "B", "A", "a", "b"]


def test_paced_words_and_sentences(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", "Old men"), (1, 1, "paragraph", "Hi. Yes"), (1, 2, "paragraph", "")], "doc_id long, block long, type string, content string")
    speeds = blocks.select("doc_id", "block", F.lit(1.0).alias("wpm_factor"))
    words = [(r.block, r.unit, r.ms, r.start_ms) for r in X.paced_words(blocks, speeds, 300, 2.0, adaptive=False).orderBy("block", "unit").collect()]
    assert words == [(0, 0, 200, 0), (0, 1, 400, 200), (1, 0, 400, 600), (1, 1, 200, 1000)]  # the heading's last word waits, and so does the full stop
    sentences = [(r.block, r.unit, r.ms, r.start_ms) for r in X.paced_sentences(blocks, speeds, 300, 2.0).orderBy("block", "unit").collect()]
    assert sentences == [(0, 0, 800, 0), (1, 0, 400, 800), (1, 1, 300, 1200)]


def test_speed_emphasis(spark):
    rows = spark.createDataFrame([(w,) for w in (100, 199, 200, 399, 400, 599, 600, 900)], "wpm long")
    assert [r[0] for r in rows.select(X.proportion_at(F.col("wpm"))).collect()] == [0.35, 0.35, 0.4, 0.4, 0.45, 0.45, 0.5, 0.5]


def test_report(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran."), (2, None), (3, "Institutional considerations notwithstanding, internationalisation necessitates comprehensive organisational responsibility. " * 3)], "doc_id long, text string")
    rows = {r.doc_id: r for r in E.report(E.readability(docs)).collect()}
    assert rows[1].summary == "Very easy to read (5th grade)" and rows[1].recommendation == "This text is easy - you can read 15% faster"
    assert rows[2].recommendation == "Normal reading speed recommended"
    assert rows[3].recommendation == "Consider reading 20% slower for better comprehension" and rows[3].summary.startswith("Very difficult (Grade ")


def test_grid_and_charts(spark):
    daily = spark.createDataFrame([(1, "2024-01-30", 90_000, 10)], "user_id long, day string, time_ms long, words long").select("user_id", F.col("day").cast("date").alias("day"), "time_ms", "words", *(F.lit(1).alias(c) for c in ("sessions", "opened", "completed")))
    series = K.dense_series(daily, "2024-02-02", 35)
    grid = {str(r.day): r for r in K.calendar_grid(series).collect()}
    assert (grid["2023-12-30"].week, grid["2023-12-30"].weekday, grid["2023-12-30"].month) == (0, 6, "Dec")
    assert (grid["2023-12-31"].week, grid["2023-12-31"].weekday, grid["2023-12-31"].month) == (1, 0, None)
    assert [d for d, r in sorted(grid.items()) if r.month] == ["2023-12-30", "2024-01-01", "2024-02-01"]
    history = daily.select("user_id", "day", F.lit(210).cast("long").alias("avg_wpm"))
    rows = {str(r.day): r for r in K.charts(series, history, "2024-02-02").collect()}
    assert (rows["2024-01-30"].minutes, rows["2024-01-30"].words, rows["2024-01-30"].wpm, rows["2024-01-30"].in_sparkline) == (2, 10, 210, True)
    assert rows["2024-01-19"].minutes is None and rows["2024-01-20"].minutes == 0 and rows["2024-01-20"].wpm is None
