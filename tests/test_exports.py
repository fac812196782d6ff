"""Exports of statistics read back, states of three replicas, searches from SQL."""

import datetime
import json

from pyspark.sql import functions as F

from lectern.functions import search
from lectern.operators import exports as EX
from lectern.operators import merge as M
from lectern.operators import state as ST
from lectern.operators import text as T

DAY = datetime.date(2024, 1, 1)


def sessions_of(spark, rows):
    data = [(i, user, datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day), DAY + datetime.timedelta(days=day), ms, doc, done, wpm, ms * wpm // 60_000) for i, (user, day, hour, ms, doc, done, wpm) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, user_id long, ts timestamp, day date, duration_ms long, document_id long, completed boolean, wpm long, words long")


def test_json_export_reads_back(spark, tmp_path):
    sessions = sessions_of(spark, [(1, -200, 9, 7_200_000, 1, True, 200), (1, -199, 9, 60_000, 1, True, 220), (1, 0, 9, 60_000, 2, False, 300), (1, -1, 10, 30_000, 3, True, 200), (2, 0, 1, 10_000, 1, False, 100)])
    notes = spark.createDataFrame([(1, DAY), (3, DAY), (1, DAY - datetime.timedelta(days=200))], "user_id long, day date")
    goals = spark.createDataFrame([(1, 5, 60, 2)], "user_id long, daily_minutes int, weekly_minutes int, monthly_documents int")
    EX.write_json(EX.stats_export(sessions, notes, goals, "2024-01-02", "2024-01-02T00:00:00Z"), f"file://{tmp_path}/x")
    found = {r.user_id: json.loads(r.json) for r in EX.read_json_lines(spark, f"file://{tmp_path}/x").collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert list(one)[:4] == ["user_id", "exportedAt", "version", "lifetime"] and one["version"] == "1.0" and one["goals"] == {"dailyMinutes": 5, "weeklyMinutes": 60, "monthlyDocuments": 2}
    assert [d["date"] for d in one["dailyStats"]] == ["2023-12-31", "2024-01-01"] and one["dailyStats"][1] == {"date": "2024-01-01", "readingTimeMs": 60_000, "readingTimeFormatted": "1m", "wordsRead": 300, "documentsOpened": 1, "documentsCompleted": 0, "annotationsCreated": 1}
    assert one["weeklyStats"] == [{"weekStart": "2023-06-12", "readingTimeMs": 7_260_000, "readingTimeFormatted": "2h 1m", "wordsRead": 24_220, "documentsCompleted": 2, "annotationsCreated": 1, "avgWpm": 210, "sessionCount": 2, "activeDays": 2}]
    assert one["lifetime"] == {"totalReadingTimeMs": 7_350_000, "totalReadingTimeFormatted": "2h 2m", "totalWordsRead": 24_620, "totalDocumentsCompleted": 3, "totalAnnotationsCreated": 2, "currentStreak": 2, "longestStreak": 2, "lastReadingDate": "2024-01-01"}
    assert one["personalBests"]["longestSession"] == {"date": "2023-06-15", "durationMs": 7_200_000, "durationFormatted": "2h 0m"} and one["personalBests"]["fastestWpm"] == {"date": "2024-01-01", "wpm": 300}
    assert len(one["hourlyActivity"]) == 24 and [h["hour"] for h in one["hourlyActivity"]] == list(range(24)) and [w["date"] for w in one["wpmHistory"]] == sorted(w["date"] for w in one["wpmHistory"])
    assert found[2]["personalBests"]["fastestWpm"] is None and found[3]["dailyStats"][0]["annotationsCreated"] == 1 and found[3]["hourlyActivity"] == [] and found[3]["goals"] is None
    report = EX.read_json_lines(spark, f"file://{tmp_path}/x")
    from lectern.operators.exchange import stats_import_report

    assert {(r.user_id, r.valid, r.words, r.days, r.weeks) for r in stats_import_report(report).collect()} == {(1, True, 24_620, 2, 1), (2, True, 16, 1, 0), (3, True, 0, 1, 0)}


def test_csv_sections_read_back(spark, tmp_path):
    sessions = sessions_of(spark, [(1, 0, 9, 3_660_000, 2, False, 300), (2, -1, 10, 30_000, 3, True, 200)])
    found = EX.sections(sessions, spark.createDataFrame([(1, DAY)], "user_id long, day date"), "2024-01-02")
    odd = spark.createDataFrame([(1, 'a "quoted", one', "two\nlines"), (2, "", None), (3, "plain", "'x';")], "user_id long, title string, note string")
    EX.write_csv({**found, "titles": odd}, f"file://{tmp_path}")
    for name, df in {**found, "titles": odd}.items():
        assert sorted(map(str, EX.read_csv(spark, f"file://{tmp_path}", name, df).collect())) == sorted(map(str, df.collect())), name
    header = next(p for p in (tmp_path / "daily").glob("*.csv") if p.read_text()).read_text().splitlines()
    assert header[0] == "User,Date,Reading Time,Reading Time (ms),Words Read,Docs Opened,Docs Completed,Annotations" and ",1h 1m,3660000," in "".join(header)


def test_states_of_three_replicas(spark):
    heads = spark.createDataFrame([(0, 1, 5, 2, True, None, "a"), (1, 1, 9, 1, False, True, "b"), (2, 1, 9, 3, True, False, "c"), (0, 2, 1, 1, True, True, "x")], "replica int, user_id long, updated_at long, schema_version int, onboarding_completed boolean, exit_confirmation_dismissed boolean, settings string")
    notes = spark.createDataFrame([(0, 1, "d", "n", 7, "red"), (1, 1, "d", "n", 7, "blue"), (2, 1, "d", "n", 7, "green"), (2, 1, "d", "m", 1, "old"), (0, 1, "d", "m", 2, "new"), (9, 1, "d", "k", 1, "unknown")], "replica int, user_id long, doc_key string, id string, created long, color string")
    presets = spark.createDataFrame([(r, 1, p, f"{p}{r}") for r in range(3) for p in "abc" if not (p == "c" and r == 2)], "replica int, user_id long, id string, name string")
    stones = spark.createDataFrame([(0, 1, "k", DAY), (2, 1, "k", DAY + datetime.timedelta(days=1)), (1, 1, "2", DAY)], "replica int, user_id long, key string, deleted_at date")
    items = spark.createDataFrame(
        [(1, i, f"t{r}", "a", "pdf", "s", DAY, DAY + datetime.timedelta(days=r), 10 * r, 1, r, 5, None, None, r) for r in range(3) for i in (1, 2, 3 + r)],
        "user_id long, id long, title string, author string, type string, source_label string, created date, last_opened date, percent long, chapter long, block long, word_count long, file_hash string, url string, replica int",
    )
    positions = spark.createDataFrame([(r, 1, "d", c, b, r) for r, c, b in ((0, 1, 9), (1, 2, 1), (2, 2, 0))], "replica int, user_id long, doc_key string, chapter long, block long, last_opened long")
    weeks = spark.createDataFrame([(r, 1, DAY, 10 * r, 5, 1, 2, 3, 200 + r) for r in range(3)], "replica int, user_id long, week date, time_ms long, words long, completed long, sessions long, active_days long, avg_wpm long")
    sessions = sessions_of(spark, [(1, 0, 9, 60_000, 2, False, 300), (1, 0, 10, 30_000, 3, True, 200), (1, 1, 10, 30_000, 3, True, 200)]).withColumn("replica", (F.col("event_id") % 3).cast("int"))
    given = {"stones": stones, "items": items, "positions": positions, "annotations": notes, "presets": presets, "weeks": weeks, "sessions": sessions, "totals": weeks.select("replica", "user_id", "time_ms", "words")}
    out = ST.merged_states(heads, given)
    assert sorted(map(tuple, out["heads"].collect())) == [(1, 3, False, True, "b", 1, True), (2, 1, True, True, "x", 0, False)], "flags and settings of the newest, the lower replica on ties"
    assert {(r.id, r.color) for r in out["annotations"].collect()} == {("n", "blue"), ("m", "new"), ("k", "unknown")}
    assert {(r.id, r.name) for r in out["presets"].collect()} == {("a", "a2"), ("b", "b2"), ("c", "c1")}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(out["stones"]) == rows(M.merged_tombstones(stones)) and {(r.key, str(r.deleted_at)) for r in out["stones"].collect()} == {("k", "2024-01-02"), ("2", "2024-01-01")}
    assert rows(out["items"]) == rows(M.merged_library(items, M.merged_tombstones(stones))) and {r.id for r in out["items"].collect()} == {1, 3, 4, 5}
    assert rows(out["positions"]) == rows(M.further_positions(positions, "user_id", "doc_key")) and [(r.chapter, r.block) for r in out["positions"].collect()] == [(2, 1)]
    assert [(r.time_ms, r.avg_wpm) for r in out["weeks"].collect()] == [(20, 201)] and [tuple(r) for r in out["totals"].collect()] == [(1, 20, 5)]
    assert rows(out["days"]) == rows(M.merged_daily(sessions)) and rows(out["hours"]) == rows(M.merged_hours(sessions))
    assert [tuple(r) for r in ST.changed_users(heads.where("user_id = 2"), items, out["items"], 0).collect()] == [(2, False)]
    assert set(ST.merged_states(heads.where("false"), {})) == {"heads"}


def test_search_blocks(spark):
    search.register(spark)
    docs = spark.createDataFrame([(1, 0, "The Café, über-all; CAFÉ! of (the) end"), (2, 1, None), (3, 2, ""), (4, 3, "café of\nthe ÆØ Ñandú")], "doc_id long, block long, text string")
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(9).cast("long"), "text"))
    docs.createOrReplaceTempView("search_blocks_docs")
    phrases = ["cafe", "Of the", "  ", "Über", "nandu", "que"]
    found = spark.sql(f"select doc_id, block, phrase, start_word, end_word from search_blocks(table(search_blocks_docs) partition by (doc_id), array({', '.join(repr(p) for p in phrases)}))")
    want = T.phrase_matches(docs, phrases, "doc_id", "block")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
