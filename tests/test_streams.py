"""Streams over several batches, restarted in the middle, with late and repeated rows."""

import datetime

from pyspark.sql import functions as F

from lectern.operators import stats as K
from lectern.operators.exchange import upserted
from lectern.operators.library import deleted
from lectern.streaming import habits as H
from lectern.streaming import library as L
from lectern.streaming import live as N

SESSION = "event_id long, user_id long, ts timestamp, duration_ms long, wpm long, words long"


def session(n, user, day, hour, ms, wpm=200):
    return n, user, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour), ms, wpm, ms * wpm // 60_000


def add(spark, rows, folder, number):
    spark.createDataFrame(rows, SESSION).coalesce(1).write.parquet(f"{folder}/in/part={number}")


def stream(spark, folder):
    return spark.readStream.schema(SESSION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


BATCHES = [
    [session(1, 1, 0, 9, 90_000, 210), session(2, 1, 0, 8, 50_000, 900), session(3, 2, 0, 1, 20_000)],
    [session(4, 1, 1, 9, 70_000, 300), session(5, 1, 0, 7, 30_000), session(6, 2, 3, 5, 130_000, 150)],
    [session(7, 1, 2, 9, 90_000, 300), session(8, 1, 2, 6, 45_000), session(9, 2, 4, 5, 60_000, 151)],
    [session(10, 1, 6, 9, 200_000, 100), session(10, 1, 6, 9, 200_000, 100), session(11, 2, 5, 5, 61_000, 151), session(12, 1, 7, 1, 61_000, 300)],
    [session(13, 1, 8, 1, 10_000), session(14, 3, 8, 2, 5_000), session(15, 2, 6, 0, 5_000)],
]


def test_events_equal_the_batch_answers(spark, tmp_path):
    """Streaks, bests and goals after five batches, read in two runs of the stream, equal K3, K6 and K23."""
    folder, goals = f"file://{tmp_path}", spark.createDataFrame([(1, 2), (2, 1)], "user_id long, daily_minutes long")
    for k in (0, 1):
        add(spark, BATCHES[k], folder, k)
    first = H.reading_events(stream(spark, folder), goals, f"{folder}/out").collect()
    assert {r.user_id for r in first} == {1, 2}
    for k in (2, 3, 4):
        add(spark, BATCHES[k], folder, k)
    rows = {(r.user_id, r.kind, r.goal_day): (r.day, r.value, r.other) for r in H.reading_events(stream(spark, folder), goals, f"{folder}/out").collect()}

    whole = spark.createDataFrame(sorted({r for b in BATCHES for r in b}), SESSION).withColumns({"day": F.to_date("ts"), "document_id": F.lit(1), "completed": F.lit(False)})
    want = {(r.user_id, "streak", None): (r.last_day, r.current_streak, r.longest_streak) for r in K.streaks(whole.select("user_id", "day").distinct()).collect()}
    for r in K.personal_bests(whole).collect():
        want[r.user_id, "longest_session", None] = r.longest_day, r.longest_ms, None
        want[r.user_id, "most_words", None] = r.most_words_day, r.most_words, None
        if r.fastest_wpm is not None:
            want[r.user_id, "fastest", None] = r.fastest_day, r.fastest_wpm, None
    for r in K.goal_crossings(whole, goals).collect():
        want[r.user_id, "goal", r.day] = r.day, r.total_ms, r.event_id
    assert rows == want
    assert want[1, "streak", None][1:] == (3, 3) and sum(k[1] == "goal" for k in want) == 6
    batches = spark.read.parquet(f"{folder}/out/rows")
    assert batches.where("kind = 'streak' and user_id = 3").count() == 1, "what has not changed is not given again"


def test_late_rows_are_missing_and_repaired(spark, tmp_path):
    folder = f"file://{tmp_path}"
    batches = [[session(1, 1, 0, 9, 10_000)], [session(2, 1, 5, 9, 20_000), session(3, 2, 5, 1, 7_000)], [session(4, 1, 6, 0, 6_000)], [session(5, 1, 0, 10, 40_000), session(6, 1, 6, 3, 9_000)]]
    for k, b in enumerate(batches):
        add(spark, b, folder, k)
    live = N.daily(stream(spark, folder), f"{folder}/live")
    H.kept_sessions(stream(spark, folder), f"{folder}/kept")
    fixed = H.repaired_days(stream(spark, folder), f"{folder}/kept", live)
    of = lambda df: {(r.user_id, r.day.day): (r.time_ms, r.sessions) for r in df.collect()}
    assert of(live) == {(1, 1): (10_000, 1), (1, 6): (20_000, 1), (2, 6): (7_000, 1), (1, 7): (15_000, 2)}
    assert of(fixed) == of(live) | {(1, 1): (50_000, 2)}
    late = spark.read.parquet(f"{folder}/kept/late").select("user_id", "day").collect()
    assert [(r.user_id, r.day.day) for r in late] == [(1, 1)]


CHANGE = "event_id long, ts timestamp, user_id long, kind string, id string, title string, author string, type string, url string, file_hash string, word_count long"


def change(n, user, hour, kind="open", id=None, title=None, url=None, file_hash=None, author=None):
    return n, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour), user, kind, id, title, author, "pdf" if file_hash else "web", url, file_hash, None


def test_library_equals_batches_of_g9_and_h16(spark, tmp_path):
    folder = f"file://{tmp_path}"
    batches = [
        [change(1, 1, 1, title="one", file_hash="h1", author="x"), change(2, 1, 2, title="page", url="https://x.org/a"), change(3, 2, 3, title="other", file_hash="h1")],
        [change(4, 1, 4, title="one again", file_hash="h1"), change(5, 2, 5, "delete", id="file_pdf_h1"), change(6, 3, 5, title="third", file_hash="h3"), change(1, 1, 1, title="one", file_hash="h1", author="x")],
        [change(7, 2, 6, title="back", file_hash="h1"), change(8, 3, 6, "delete", id="file_pdf_h3"), change(9, 3, 7, title="opened since", file_hash="h3"), change(6, 3, 5, title="third", file_hash="h3")],
    ]
    for k, b in enumerate(batches[:2]):
        spark.createDataFrame(b, CHANGE).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    changes = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    first = {(r.user_id, r.id): r.title for r in L.kept_up(changes(), f"{folder}/out").collect()}
    assert {t for t in first.values()} == {"one again", "page", "third"}
    spark.createDataFrame(batches[2], CHANGE).coalesce(1).write.parquet(f"{folder}/in/part=2")
    found = sorted(map(tuple, L.kept_up(changes(), f"{folder}/out").collect()), key=str)

    want = spark.createDataFrame([], L.ITEM)
    for own in (batches[0], batches[1][:3], batches[2][:3]):
        rows = spark.createDataFrame(own, CHANGE)
        want = upserted(want, rows.where("kind = 'open'").withColumnRenamed("ts", "opened").drop("id"))
        gone = want.join(rows.where("kind = 'delete'").select("user_id", "id", "ts"), ["user_id", "id"]).where("ts >= last_opened").select("user_id", "id")
        want = spark.createDataFrame(deleted(want, gone, None)[0].select(*(c.split(" ")[0] for c in L.ITEM.split(", "))).collect(), L.ITEM)
    assert found == sorted(map(tuple, want.select(*(c.split(" ")[0] for c in L.ITEM.split(", "))).collect()), key=str)
    assert {r.key for r in L.tombstones(spark, f"{folder}/out").collect()} == {"file_pdf_h1", "hash:h1"}

    L.apply_changes(spark.createDataFrame(batches[2][:3], CHANGE), f"{folder}/out", 2)
    assert sorted(map(tuple, L.items(spark, f"{folder}/out").collect()), key=str) == found, "a batch that runs again changes nothing"


def test_library_reads_a_batch_once(spark, tmp_path, monkeypatch):
    """changes are a table before they are grouped and joined, so that the stream's state is read and written once for a batch."""
    plans, folder = [], f"file://{tmp_path}"

    def watched(known, opened, *args, **options):
        plans.append(opened._jdf.queryExecution().executedPlan().toString())
        now = upserted(known, opened, *args, **options)
        plans.append(now._jdf.queryExecution().executedPlan().toString())
        return now

    monkeypatch.setattr(L, "upserted", watched)
    spark.createDataFrame([change(1, 1, 1, title="one", file_hash="h1"), change(2, 1, 2, "delete", id="file_pdf_h1")], CHANGE).coalesce(1).write.parquet(f"{folder}/in")
    assert L.kept_up(spark.readStream.schema(CHANGE).parquet(f"{folder}/in"), f"{folder}/out").collect() == []
    assert len(plans) == 2 and not any(x in p for p in plans for x in ("ExistingRDD", "InMemoryTableScan", "StreamingDeduplicate"))
    assert plans[1].count("collect_set") == 0, "inputs are grouped once"


def test_a_user_is_read_and_written_once_a_batch(spark, tmp_path):
    """what is known of a user is one value with its sessions as text, rows come and go as rows, and no batch runs without rows."""

    class Value:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return value

    class Timer:
        def getCurrentWatermarkInMs(self):
            return 3 * 86_400_000

    value, day = Value(), 86_400_000_000
    rows = lambda *texts: iter(H.Row("user_id", "ts", "session")(1, None, t) for t in texts)
    user = H._Habits()
    user.init(Handle())
    first = {r.kind: (r.day.day, r.value, r.other) for r in user.handleInputRows((1,), rows(f"{2 * day} 5 90000 300 200 60000", f"{3 * day} 6 1000 3 200 null", f"{3 * day} 6 1000 3 200 null"), Timer())}
    assert first == {"streak": (4, 2, 2), "longest_session": (3, 90_000, None), "most_words": (3, 300, None), "fastest": (3, 200, None), "goal": (3, 90_000, 5)}
    assert value.held[-1] == f"{3 * day} 6 1000 3 200 null" and value.held[-2] == 3, "the closed day is folded, the open one is held"
    assert list(user.handleInputRows((1,), rows(f"{3 * day} 6 1000 3 200 null", f"{2 * day} 7 95000 3 200 null"), Timer())) == [], "a repeated row and one of a closed day change nothing"
    assert value.calls == ["get", "update"] * 2

    folder, goals = f"file://{tmp_path}", spark.createDataFrame([(1, 2)], "user_id long, daily_minutes long")
    for k in (0, 1):
        add(spark, BATCHES[k], folder, k)
    H.reading_events(stream(spark, folder), goals, f"{folder}/out")
    assert sorted(p.name for p in (tmp_path / "out" / "rows").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
