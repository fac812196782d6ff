"""Queries that read events as a stream, and the SQL of their final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import statistics as S
from lectern.plans.statistics import SESSIONS
from lectern.sources import bindings as B
from lectern.streaming import habits as H
from lectern.streaming import library as L
from lectern.streaming import live as N

GAP = "6 hours"


def _events(s, d):
    """Events as a stream, from one file or a folder (a pattern reads both); watermarks need times with a zone."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).parquet(f"{d}/events[.]parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _sessions(s, d):
    return B.sessions_of(_events(s, d)).drop("day")


def _long(sessions):
    """Sessions a hundred times as long, so that annotations fall into them."""
    return sessions.withColumn("duration_ms", F.least(F.col("duration_ms") * 100, F.lit(3_600_000).cast("long")))


def _notes(s, d):
    return _events(s, d).where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("note_id"))


def _repaired_days(s, d):
    folder = N.shared_folder(s, "n08")
    H.kept_sessions(_sessions(s, d), folder)
    return H.repaired_days(_sessions(s, d), folder, N.daily(_sessions(s, d), folder))


def _changes(s, d):
    """Orders as changes of a library: items opened by their file hash or url, and some of them deleted."""
    schema = s.read.parquet(f"{d}/orders.parquet").schema
    key, n = F.col("o_orderkey"), F.col("o_orderkey") % 5
    rows = s.readStream.schema(schema).parquet(f"{d}/orders[.]parquet").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    filed = key % 3 > 0
    opened = {"title": F.concat(F.lit("t"), key), "author": F.when(key % 4 > 0, F.lit("a")), "type": F.when(filed, "pdf").otherwise("web"), "url": F.when(~filed, F.concat(F.lit("https://www.x.example/"), n)), "file_hash": F.when(filed, F.concat(F.lit("h"), n)), "word_count": F.when(key % 2 > 0, key)}
    gone = F.when((key % 7 == 0) & filed, F.concat(F.lit("file_pdf_h"), n))
    every = rows.select(key.alias("event_id"), "ts", F.col("o_custkey").alias("user_id"), F.when(gone.isNotNull(), "delete").otherwise("open").alias("kind"), gone.alias("id"), *(v.alias(k) for k, v in opened.items()))
    return every


def _library(s, d):
    return L.kept_up(_changes(s, d), N.shared_folder(s, "n06")).withColumns({c: F.to_date(c) for c in ("created", "last_opened")}).drop("id")


def _habit_sql() -> str:
    """The batch answers of K3 (days with a session), K6 and K23, a row for each event."""
    streaks, bests, goals = (S.ORACLE_SQL[k] for k in ("k03_streaks", "k06_personal_bests", "k23_goal_crossings"))
    streaks = streaks.replace(S.DAILY, f"{SESSIONS}, daily as (select distinct user_id, day from sessions)")
    row = "select user_id, '{0}' as kind, {1} as goal_day, {2} as day, {3}::bigint as value, {4}::bigint as other from ({5}) x"
    none = "null::date"
    return " union all ".join((
        row.format("streak", none, "last_day", "current_streak", "longest_streak", streaks),
        row.format("longest_session", none, "longest_day", "longest_ms", "null", bests),
        row.format("fastest", none, "fastest_day", "fastest_wpm", "null", bests) + " where fastest_wpm is not null",
        row.format("most_words", none, "most_words_day", "most_words", "null", bests),
        row.format("goal", "day", "day", "total_ms", "event_id", goals),
    ))


QUERIES = {
    "n01_live_days": lambda s, d: N.daily(_sessions(s, d), N.shared_folder(s, "n01")),
    "n02_live_hours": lambda s, d: N.hourly(_sessions(s, d), N.shared_folder(s, "n02")).select("user_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "time_ms", "words", "sessions"),
    "n03_live_weeks": lambda s, d: N.rolling_week(_sessions(s, d), N.shared_folder(s, "n03")),
    "n04_sittings": lambda s, d: N.sittings(_events(s, d).select("user_id", "ts"), N.shared_folder(s, "n04"), GAP).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events"),
    "n05_reading_events": lambda s, d: H.reading_events(_sessions(s, d), S._goals(B.sessions(s, d)), N.shared_folder(s, "n05")),
    "n06_library": _library,
    "n08_repaired_days": _repaired_days,
    "n07_annotated_sessions": lambda s, d: N.annotated_sessions(_long(_sessions(s, d)), _notes(s, d), N.shared_folder(s, "n07")),
}

_SUMS = "sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(*) as sessions"
ORACLE_SQL = {
    "n01_live_days": f"with {SESSIONS} select user_id, day, {_SUMS} from sessions group by user_id, day",
    "n05_reading_events": _habit_sql(),
    "n06_library": """with c as (select *, o_orderkey % 3 > 0 as filed, o_orderkey % 5 as n from orders),
o as (select o_custkey as user_id, 't' || o_orderkey as title, case when o_orderkey % 4 > 0 then 'a' end as author, case when filed then 'pdf' else 'web' end as type, case when not filed then 'https://www.x.example/' || n end as url, case when filed then 'h' || n end as file_hash, case when o_orderkey % 2 > 0 then o_orderkey end as word_count, o_orderdate::date as opened from c where not (o_orderkey % 7 = 0 and filed)),
i as (select *, opened as created, opened as last_opened from o qualify row_number() over (partition by user_id, type, url, file_hash order by opened desc, title desc) = 1),
g as (select o_custkey as user_id, 'h' || n as file_hash, max(o_orderdate::date) as gone_at from c where o_orderkey % 7 = 0 and filed group by all)
select user_id, title, author, type, url, file_hash, word_count, created, last_opened from i left join g using (user_id, file_hash) where gone_at is null or gone_at < last_opened""",
    "n08_repaired_days": f"with {SESSIONS} select user_id, day, {_SUMS} from sessions group by user_id, day",
    "n02_live_hours": f"with {SESSIONS} select user_id, strftime(ts, '%Y-%m-%d %H') as hour, {_SUMS} from sessions group by all",
    "n03_live_weeks": f"with {SESSIONS}, spread as (select *, unnest(range(7)) as back from sessions) select user_id, (day - back::int) as day, {_SUMS} from spread group by all",
    "n04_sittings": f"with g as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval {GAP}, true) as opens from events), r as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as run from g), w as (select user_id, run, min(ts) as first, max(ts) + interval {GAP} as last, count(*) as events from r group by all) select user_id, epoch_us(first) as start_us, epoch_us(last) as end_us, events from w where last <= (select date_trunc('milliseconds', max(ts)) - interval 1 day from events)",
    "n07_annotated_sessions": f"with {SESSIONS} select s.user_id, s.event_id as session_id, e.event_id as note_id from sessions s join events e on e.user_id = s.user_id and e.event_type = 'signup' and e.ts >= s.ts and epoch_us(e.ts) <= epoch_us(s.ts) + least(s.duration_ms * 100, 3600000) * 1000",
}
