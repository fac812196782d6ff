"""Streaks, personal bests and goal crossings over a stream of sessions, in keyed state that outlives a batch; and days that late rows
belong to, repaired.

A user's state is the sessions of the days that the watermark has not passed, and a summary of the days before them: the last run of days,
the longest one, and the bests.  Out-of-order sessions of open days change what is known of them, so an event (a streak, a best, the
session that reaches a day's goal) can be given again with another value; of each key the last one counts (``live.latest``).  Closed days
are folded into the summary, so a state grows with the sessions of ``LATE`` and not with time.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.operators.stats import FAST_MS
from lectern.streaming.live import LATE, latest, written

EVENTS = "user_id long, kind string, goal_day date, day date, value long, other long"
_SUMMARY = "run_first int, run_last int, longest int, best_ms long, best_ms_at long, best_wpm long, best_wpm_at long, best_words long, best_words_day int, closed int"
_SESSION = ("at", "event_id", "duration_ms", "words", "wpm", "goal_ms")
_EVENT = Row(*(c.split(" ")[0] for c in EVENTS.split(", ")))
_NOTHING = (None, None, 0, None, None, None, None, None, None, -(1 << 30))
_DAY_US = 86_400_000_000
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state needs, and run no batch without rows, in which no user changes
    (the watermark of the last batch holds for the next one all the same)."""
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def folded(summary: tuple, sessions: list[tuple]) -> tuple:
    """A summary with the days of the sessions (at, event_id, duration_ms, words, wpm, goal_ms) added, all of them later than its own.
    Ties keep the earliest."""
    first, last, longest, ms, ms_at, wpm, wpm_at, words, words_day, closed = summary
    by_day: dict[int, int] = {}
    for at, _, duration, read, speed, _ in sorted(sessions):
        by_day[at // _DAY_US] = by_day.get(at // _DAY_US, 0) + read
        if ms is None or duration > ms:
            ms, ms_at = duration, at
        if duration >= FAST_MS and (wpm is None or speed > wpm):
            wpm, wpm_at = speed, at
    for day in sorted(by_day):
        first, last = (first, day) if last is not None and day == last + 1 else (day, day)
        longest = max(longest, last - first + 1)
        if words is None or by_day[day] > words:
            words, words_day = by_day[day], day
    return first, last, longest, ms, ms_at, wpm, wpm_at, words, words_day, closed


def facts(summary: tuple, sessions: list[tuple]) -> dict[tuple, tuple]:
    """What holds after the sessions: (kind, day of a goal) to (day, value, other)."""
    first, last, longest, ms, ms_at, wpm, wpm_at, words, words_day, _ = folded(summary, sessions)
    out: dict[tuple, tuple] = {}
    if last is not None:
        out["streak", None] = last, last - first + 1, longest
        out["longest_session", None] = ms_at // _DAY_US, ms, None
        out["most_words", None] = words_day, words, None
    if wpm is not None:
        out["fastest", None] = wpm_at // _DAY_US, wpm, None
    total: dict[int, int] = {}
    for at, event, duration, _, _, goal in sorted(sessions):
        day = at // _DAY_US
        before = total.get(day, 0)
        total[day] = before + duration
        if goal is not None and before < goal <= before + duration:
            out["goal", day] = day, before + duration, event
    return out


def _date(day: int | None) -> datetime.date | None:
    return None if day is None else datetime.date(1970, 1, 1) + datetime.timedelta(days=day)


def _numbers(session: str) -> tuple:
    """The numbers of a session from their text."""
    parts = session.split(" ")
    return tuple(map(int, parts)) if "null" not in parts else tuple(None if x == "null" else int(x) for x in parts)


class _Habits(StatefulProcessor):
    """A session comes as the text of its numbers and is kept as that, and all that is known of a user is one value, read and written once
    a batch: most users have a few sessions in a batch, for which columns, frames and values of their own take longer than the work."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", f"{_SUMMARY}, sessions string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *summary, texts = self.known.get() or (*_NOTHING, "")
        summary, held = tuple(summary), {_numbers(t): t for t in texts.split("\n") if t}
        new = {_numbers(t): t for t in {r[-1] for r in rows}}
        now = held | {s: t for s, t in new.items() if s[0] // _DAY_US >= summary[-1]}  # a row that comes again is one row
        before, after = facts(summary, held), facts(summary, now)
        closed = max(summary[-1], timerValues.getCurrentWatermarkInMs() * 1000 // _DAY_US)
        summary = (*folded(summary, [t for t in now if t[0] // _DAY_US < closed])[:-1], closed)
        self.known.update((*summary, "\n".join(t for s, t in now.items() if s[0] // _DAY_US >= closed)))
        for (kind, goal), (day, value, other) in after.items():
            if before.get((kind, goal)) != (day, value, other):
                yield _EVENT(key[0], kind, _date(goal), _date(day), value, other)

    def close(self) -> None:
        pass


def reading_events(sessions: DataFrame, goals: DataFrame, folder: str) -> DataFrame:
    """The last streak, personal bests and goal crossings of each user, from a stream of sessions and a table of goals (user_id,
    daily_minutes): user_id, kind, goal_day (of goals), day, value (days, milliseconds, speed, words, milliseconds of the day so far), other
    (the longest streak; the session that reaches a goal).  A stream that is started again with its folder goes on where it was."""
    wanted = goals.select("user_id", (F.col("daily_minutes") * 60_000).cast("long").alias("goal_ms"))
    dated = sessions.withWatermark("ts", LATE).join(wanted, "user_id", "left")
    numbers = dated.withColumn("at", F.unix_micros("ts"))
    session = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null")) for c in _SESSION))
    rows = numbers.select("user_id", "ts", session.alias("session"))
    with keyed_store(sessions.sparkSession):
        events = rows.groupBy("user_id").transformWithState(_Habits(), EVENTS, "update", "EventTime")
        return latest(written(events, folder, "update"), "user_id", "kind", "goal_day")


def kept_sessions(sessions: DataFrame, folder: str) -> None:
    """Writes each batch of a stream of sessions to ``folder``/sessions, and the user and day of its late rows, those over ``LATE``
    behind the latest of the batches before, to ``folder``/late.  A batch that runs again replaces its own rows."""
    spark = sessions.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(f"{folder}/sessions/batch={number}")
        rows.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{folder}/latest/batch={number}")
        latest_before = spark.read.schema("ts timestamp, batch int").parquet(f"{folder}/latest").where(F.col("batch") < number).agg(F.max("ts")).first()[0]
        late = rows.where(F.col("ts") < F.lit(latest_before) - F.expr(f"interval {LATE}")) if latest_before else rows.where("false")
        late.select("user_id", F.to_date("ts").alias("day")).distinct().write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        rows.unpersist()

    query = sessions.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/kept-state").foreachBatch(write).start()
    query.awaitTermination()


def repaired(live: DataFrame, sessions: DataFrame, late: DataFrame) -> DataFrame:
    """Live days (user_id, day, time_ms, words, sessions) in which the days of late rows (user_id, day) are summed up again from the
    sessions that were kept; the other days are not touched."""
    days = late.select("user_id", "day").distinct()
    whole = sessions.withColumn("day", F.to_date("ts")).join(days, ["user_id", "day"], "left_semi")
    again = whole.groupBy("user_id", "day").agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.count("*").alias("sessions"))
    columns = ["user_id", "day", "time_ms", "words", "sessions"]
    return live.join(days, ["user_id", "day"], "left_anti").select(columns).union(again.select(columns))


def repaired_days(sessions: DataFrame, folder: str, live: DataFrame) -> DataFrame:
    """``repaired`` with the sessions and late days that ``kept_sessions`` has written."""
    spark = sessions.sparkSession
    kept = spark.read.schema(f"{sessions.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(f"{folder}/sessions")
    return repaired(live, kept, spark.read.schema("user_id long, day date, batch int").parquet(f"{folder}/late"))
