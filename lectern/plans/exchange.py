"""Queries of import, export, backfill, upserts, files, labels and replica statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.search import register as register_search
from lectern.operators import exchange as X
from lectern.operators import exports as EX
from lectern.operators import merge as M
from lectern.operators import state as ST
from lectern.plans import corpus as C
from lectern.plans import statistics as S
from lectern.plans.library import ITEMS
from lectern.plans.statistics import LONG, SESSIONS
from lectern.sources import bindings as B
from lectern.streaming.live import shared_folder

NOW = "2001-12-31"
STATS_JSON = """case when c_custkey % 11 = 0 then '{"version": ' when c_custkey % 7 = 0 then '{"version": "1.0", "exportedAt": "x"}' else concat('{"version": "', case when c_custkey % 5 = 0 then '2.0' else '1.0' end, '", "exportedAt": "2024", "lifetime": {"totalReadingTimeMs": 60000, "totalWordsRead": ', c_custkey, '}, "dailyStats": [', case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then '"a"' else '"a", "b"' end, ']}') end"""
NOTES_JSON = """case when s_suppkey % 11 = 0 then '[' when s_suppkey % 7 = 0 then '{"annotations": []}' else concat('{"documentTitle": "', s_name, '", "annotations": [{"text": "a", "color": "blue", "createdAt": "2024"}', case when s_suppkey % 5 = 0 then ', {"text": "b", "createdAt": "2024"}' when s_suppkey % 5 = 1 then ', {"text": "b", "color": "pink", "createdAt": "2024"}' else '' end, ']}') end"""
FILE_NAME = "concat(p_name, case p_partkey % 9 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.epub.zip' when 3 then '.azw3' when 4 then '.azw' when 5 then '.mobi' when 6 then '.txt' when 7 then '.zip' else '' end)"
SOURCE = "case id % 4 when 0 then 'selection' when 1 then type when 2 then 'web' else 'other' end"


def _items(s, d):
    return B.archive_items(s, d)


def _recents(s, d):
    return _items(s, d).select("id", F.expr(SOURCE).alias("source"), "title", "url", F.when(F.col("id") % 2 == 0, F.concat("title", F.lit(".pdf"))).alias("file_name"), "file_hash", F.col("created").alias("opened"))


def _inputs(s, d):
    i = _items(s, d).where("id % 3 = 1")
    return i.select("user_id", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("id") % 2 == 0, F.col("author")).alias("author"), "type", "url", "file_hash", F.when(F.col("id") % 5 == 0, F.col("word_count")).alias("word_count"), F.col("last_opened").alias("opened"))


def _replicas(s, d):
    """Sessions of two replicas that share a third."""
    x = B.sessions(s, d)
    return x.where("event_id % 3 <> 0").withColumn("replica", F.lit(0)).unionByName(x.where("event_id % 3 <> 1").withColumn("replica", F.lit(1)))


def _days(s, d, replica):
    return _replicas(s, d).where(F.col("replica") == replica).groupBy("user_id", "day").agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"))


def _hours(s, d, replica):
    return _replicas(s, d).where(F.col("replica") == replica).groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(F.sum("duration_ms").alias("time_ms"), F.count("*").alias("sessions"))


def _weeks(s, d):
    x = B.sessions_long(s, d)
    x = x.where("event_id % 3 <> 0").withColumn("replica", F.lit(0)).unionByName(x.where("event_id % 3 <> 1").withColumn("replica", F.lit(1)))
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    done = F.count_distinct(F.when(F.col("completed"), F.col("document_id"))).alias("completed")
    return x.groupBy("replica", "user_id", week).agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), done, F.count("*").alias("sessions"), F.count_distinct("day").alias("active_days"), F.floor(F.sum("wpm") / F.count("*") + F.lit(0.5)).cast("long").alias("avg_wpm"))


def _presets(s, d):
    return B.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("long").alias("size"))


def _heads(s, d):
    c = B.table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("local"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 13).alias("remote"), (F.col("c_custkey") % 2 == 0).alias("same_device"), (F.col("c_custkey") % 5 == 0).alias("has_changes"))


def _relative(s, d):
    e = B.table(s, d, "events")
    now, then = F.lit("2024-01-30 12:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return e.select("event_id", X.relative_time(seconds, then, now).alias("label"))


def _functions(s, d):
    X.register(s)
    B.table(s, d, "documents").createOrReplaceTempView("lectern_function_documents")
    return s.sql("select doc_id, reading_words(text) as words, reading_duration(reading_words(text) * 240L) as duration, reading_minutes(reading_words(text), 250) as minutes from lectern_function_documents")


def _heads_of_three(s, d):
    c, rows = B.table(s, d, "customer"), []
    key = F.col("c_custkey")
    for r in range(3):
        own = c.where(key % 4 != r).select(F.lit(r).alias("replica"), key.alias("user_id"), (key * (r + 3) % 7).alias("updated_at"), ((key + r) % 3 + 1).alias("schema_version"), ((key + r) % 2 == 0).alias("onboarding_completed"), ((key + r) % 5 == 0).alias("exit_confirmation_dismissed"), F.when(key % 3 == 0, F.concat(F.lit("s"), (key * (r + 1) % 4).cast("string"))).alias("settings"))
        rows.append(own)
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _stats_export(s, d):
    """The export of all users, written and read back as a user who imports it would."""
    sessions, path = B.sessions(s, d), shared_folder(s, "a04")
    EX.write_json(EX.stats_export(sessions, B.annotation_events(s, d), S._goals(sessions), B.AS_OF, B.AS_OF), path)
    return X.stats_import_report(EX.read_json_lines(s, path))


def _daily_csv(s, d):
    folder, found = shared_folder(s, "a05"), EX.sections(B.sessions(s, d), B.annotation_events(s, d), B.AS_OF)
    EX.write_csv(found, folder)
    return EX.read_csv(s, folder, "daily", found["daily"])


def _searched(s, d):
    register_search(s)
    B.table(s, d, "conversations").select(F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("long").alias("block"), "text").createOrReplaceTempView("lectern_search_blocks")
    phrases = ", ".join(f"'{p}'" for p in B.PHRASES)
    return s.sql(f"select doc_id, block as chapter, phrase, start_word, end_word from search_blocks(table(lectern_search_blocks) partition by (doc_id), array({phrases}))")


def _imported(s, d, name):
    """A section of statistics into which another replica's is imported."""
    weeks, every = _weeks(s, d), _replicas(s, d)
    own = lambda r: {"weeks": weeks.where(F.col("replica") == r).drop("replica"), "wpm": S.K.wpm_history(every.where(F.col("replica") == r)), "bests": S.K.personal_bests(every.where(F.col("replica") == r)), "goals": S._goals(every.where((F.col("replica") == r) & (F.col("event_id") % 4 > r))).withColumn("daily_minutes", F.col("daily_minutes") + r)}
    return X.imported_stats(own(0), own(1))[name]


QUERIES = {
    "a07_imported_weeks": lambda s, d: _imported(s, d, "weeks"),
    "a07_imported_speeds": lambda s, d: _imported(s, d, "wpm"),
    "a07_imported_goals": lambda s, d: _imported(s, d, "goals"),
    "a04_stats_export": _stats_export,
    "a05_daily_csv": _daily_csv,
    "m15_merged_heads": lambda s, d: ST.merged_heads(_heads_of_three(s, d)),
    "o03_search_blocks": _searched,
    "a02_snapshot": lambda s, d: X.snapshot(_items(s, d)).select("user_id", "id", "title", "author", "percent", "chapter", "block"),
    "a03_light_items": lambda s, d: X.light(_items(s, d).withColumn("content", F.concat_ws(" ", "title", "author"))).select("id", "user_id", "title", "type", "percent", "url"),
    "a06_stats_import_report": lambda s, d: X.stats_import_report(B.table(s, d, "customer").select(F.col("c_custkey").alias("file"), F.expr(STATS_JSON).alias("json"))),
    "a07_imported_days": lambda s, d: X.imported_rows(_days(s, d, 0), _days(s, d, 1), "user_id", "day"),
    "a07_imported_hours": lambda s, d: X.imported_hours(_hours(s, d, 0), _hours(s, d, 1)),
    "a07_imported_totals": lambda s, d: X.greatest_totals(_replicas(s, d).groupBy("replica", "user_id").agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words")), ["user_id"], ["time_ms", "words"]),
    "a09_notes_import_report": lambda s, d: X.notes_import_report(B.table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), F.expr(NOTES_JSON).alias("json"))),
    "a11_backfilled": lambda s, d: X.backfilled(_recents(s, d), F.lit("device")),
    "a12_file_fingerprints": lambda s, d: X.file_fingerprints(s, d, "*.parquet").select(F.regexp_replace("path", "^.*/", "").alias("file"), "length", "file_hash"),
    "a13_file_types": lambda s, d: B.table(s, d, "part").select("p_partkey", X.file_type(F.expr(FILE_NAME)).alias("type")),
    "b16_split_paragraphs": lambda s, d: B.table(s, d, "documents").select("doc_id", F.posexplode(X.split_paragraph(F.translate(F.coalesce("text", F.lit("")), "\n", " "))).alias("paragraph", "text")),
    "g09_upserted": lambda s, d: X.upserted(_items(s, d).where("id % 3 <> 2"), _inputs(s, d), F.lit(NOW).cast("date")),
    "h04_looked_up": lambda s, d: X.looked_up(_items(s, d), B.table(s, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("id"))).select("id", "user_id", "title"),
    "k27_large_numbers": lambda s, d: B.table(s, d, "orders").select("o_orderkey", X.large_number(F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 40)).cast("long")).alias("label")),
    "k27_relative_times": _relative,
    "m08_positions": lambda s, d: M.further_positions(_items(s, d).where("id % 3 <> 0").withColumn("replica", F.lit(0)).unionByName(_items(s, d).where("id % 3 <> 1").withColumns({"replica": F.lit(1), "block": (F.col("block") + 5) % 40})), "user_id", "id"),
    "m11_overwritten": lambda s, d: X.overwritten(_presets(s, d).where("id % 3 <> 0"), _presets(s, d).where("id % 3 <> 1").withColumn("size", F.col("size") + 1), "id"),
    "m12_merged_weeks": lambda s, d: X.merged_weeks(_weeks(s, d)),
    "m12_merged_totals": lambda s, d: X.greatest_totals(_replicas(s, d).groupBy("replica", "user_id").agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.max("day").alias("last_day")), ["user_id"], ["time_ms", "words", "last_day"]),
    "m18_sync_outcomes": lambda s, d: X.sync_outcome(_heads(s, d)),
    "o01_sql_functions": _functions,
}

_I = f"with {ITEMS}"
_REPLICAS = "replicas as (select *, 0 as replica from sessions where event_id % 3 <> 0 union all select *, 1 as replica from sessions where event_id % 3 <> 1)"
_S = f"with {SESSIONS}, {_REPLICAS}"
_day = lambda r: f"(select user_id, day, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words from replicas where replica = {r} group by all)"
_TYPE = "case when source in ('pdf', 'docx', 'epub', 'mobi', 'paste') then source else 'web' end"
_BARE = f"regexp_replace(lower({FILE_NAME}), '\\.zip$', '')"
_tenths = lambda unit, mark: f"((n * 10 + {unit // 2}) // {unit} // 10) || '.' || ((n * 10 + {unit // 2}) // {unit} % 10) || '{mark}'"
_ago = lambda n, unit: f"{n} || ' {unit}' || case when {n} = 1 then '' else 's' end || ' ago'"

_WEEK_ROWS = "w as (select replica, user_id, date_trunc('week', day)::date as week, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(distinct document_id) filter (completed) as completed, count(*) as sessions, count(distinct day) as active_days, floor(sum(wpm)::double / count(*) + 0.5::double)::bigint as avg_wpm from replicas group by all)"

ORACLE_SQL = {
    "a07_imported_weeks": f"with {LONG}, {_REPLICAS}, {_WEEK_ROWS} select * exclude (replica) from w where replica = 0 union all select * exclude (replica) from w where replica = 1 and (user_id, week) not in (select (user_id, week) from w where replica = 0)",
    "a07_imported_speeds": f"{_S}, h as (select * from (select replica, user_id, day, floor(sum(wpm)::double / count(*) + 0.5)::bigint as avg_wpm, count(*) as sessions from replicas group by all) qualify row_number() over (partition by replica, user_id order by day desc) <= 90) select * exclude (replica) from h where replica = 0 union all select * exclude (replica) from h where replica = 1 and (user_id, day) not in (select (user_id, day) from h where replica = 0)",
    "a07_imported_goals": f"{_S}, g as (select user_id, min(replica) as replica from replicas where event_id % 4 > replica group by user_id) select user_id, 1 + user_id % 5 + replica as daily_minutes, 5 + user_id % 20 as weekly_minutes, 1 + user_id % 4 as monthly_documents from g",
    "a04_stats_export": f"with {S.DAILY} select user_id, true as valid, null::varchar as error, sum(words)::bigint as words, sum(completed)::bigint as documents, count(*) filter (day >= date '{B.AS_OF}' - 90) as days, 0::bigint as weeks from daily group by user_id",
    "a05_daily_csv": f"with {S.DAILY} select user_id, day, case when time_ms >= 3600000 then (time_ms // 3600000) || 'h ' else '' end || (time_ms // 60000 % 60) || 'm' as reading_time, time_ms, words, opened, completed, annotations from daily where day >= date '{B.AS_OF}' - 90",
    "m15_merged_heads": """with h as (select r as replica, c_custkey as user_id, c_custkey * (r + 3) % 7 as updated_at, (c_custkey + r) % 3 + 1 as schema_version, (c_custkey + r) % 2 = 0 as onboarding_completed, (c_custkey + r) % 5 = 0 as exit_confirmation_dismissed, case when c_custkey % 3 = 0 then 's' || (c_custkey * (r + 1) % 4) end as settings from customer, (select unnest(range(3)) as r) where c_custkey % 4 <> r),
w as (select * from h qualify row_number() over (partition by user_id order by updated_at desc, replica) = 1), g as (select user_id, max(schema_version) as schema_version, count(distinct coalesce(settings, '')) > 1 as settings_differ from h group by user_id)
select user_id, g.schema_version, onboarding_completed, exit_confirmation_dismissed, settings, replica::int as winner, settings_differ from w join g using (user_id)""",
    "o03_search_blocks": C.ORACLE_SQL["f03_chapter_search"],
    "a02_snapshot": f"{_I} select user_id, id, coalesce(title, 'Untitled') as title, coalesce(author, '') as author, percent, coalesce(chapter, 0) as chapter, block from items",
    "a03_light_items": f"{_I} select id, user_id, title, type, percent, url from items",
    "a06_stats_import_report": f"with f as (select c_custkey as file, {STATS_JSON} as json from customer), j as (select file, json_valid(json) as ok, case when json_valid(json) then json::json end as j from f), e as (select *, case when not ok then 'Invalid JSON file' when json_extract_string(j, '$.version') is null or json_extract_string(j, '$.exportedAt') is null or json_extract(j, '$.lifetime') is null then 'Invalid file format: missing required fields' when json_extract_string(j, '$.version') <> '1.0' then 'Unsupported version: ' || (json_extract_string(j, '$.version')) end as error from j) select file, error is null as valid, error, case when error is null then coalesce(json_extract_string(j, '$.lifetime.totalWordsRead')::bigint, 0) end as words, case when error is null then 0 end::bigint as documents, case when error is null then json_array_length(j, '$.dailyStats') end::bigint as days, case when error is null then 0 end::bigint as weeks from e",
    "a07_imported_days": f"{_S}, a as {_day(0)}, b as {_day(1)} select * from a union all select * from b where (user_id, day) not in (select (user_id, day) from a)",
    "a07_imported_hours": f"{_S} select user_id, hour(ts) as hour, sum(duration_ms)::bigint as time_ms, count(*) as sessions from replicas group by all",
    "a07_imported_totals": f"{_S} select user_id, max(t) as time_ms, max(w) as words from (select user_id, replica, sum(duration_ms)::bigint as t, sum(words)::bigint as w from replicas group by all) group by user_id",
    "a09_notes_import_report": "select s_suppkey as file, s_suppkey % 11 <> 0 and s_suppkey % 7 <> 0 and s_suppkey % 5 <> 0 as valid, case when s_suppkey % 11 <> 0 and s_suppkey % 7 <> 0 and s_suppkey % 5 <> 0 then case when s_suppkey % 5 = 1 then 2 else 1 end end::bigint as annotations from supplier",
    "a11_backfilled": f"{_I}, r as (select *, {SOURCE} as source, case when id % 2 = 0 then title || '.pdf' end as file_name from items) select id, {_TYPE} as type, title, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), ''), url, file_name, source) as source_label, url, created, created as last_opened, file_hash, 'device' as device_id, false as sync_enabled, null::varchar as sync_provider, null::timestamp as last_sync from r",
    "a13_file_types": f"select p_partkey, case when regexp_matches({_BARE}, '\\.(pdf|docx|epub|mobi)$') then regexp_extract({_BARE}, '\\.([a-z]+)$', 1) when regexp_matches({_BARE}, '\\.azw3?$') then 'mobi' end as type from part",
    "h04_looked_up": f"{_I} select id, user_id, title from items where id in (select l_orderkey from lineitem where l_linenumber = 4)",
    "k27_large_numbers": f"select o_orderkey, case when n >= 1000000 then {_tenths(1_000_000, 'M')} when n >= 1000 then {_tenths(1000, 'K')} else n::varchar end as label from (select o_orderkey, floor(o_totalprice * (o_orderkey % 40))::bigint as n from orders)",
    "k27_relative_times": f"with t as (select event_id, ts, floor(epoch(timestamp '2024-01-30 12:00:00') - floor(epoch(ts)))::bigint as s from events) select event_id, case when s < 60 then 'Just now' when s // 60 < 60 then {_ago('(s // 60)', 'minute')} when s // 3600 < 24 then {_ago('(s // 3600)', 'hour')} when s // 86400 = 1 then 'Yesterday' when s // 86400 < 7 then {_ago('(s // 86400)', 'day')} else strftime(ts, '%b %-d') || case when year(ts) <> 2024 then strftime(ts, ', %Y') else '' end end as label from t",
    "m08_positions": f"{_I}, b as (select *, 0 as replica from items where id % 3 <> 0 union all by name select * replace ((block + 5) % 40 as block), 1 as replica from items where id % 3 <> 1) select user_id, id, arg_max(chapter, (coalesce(chapter, 0), block, last_opened, -replica)) as chapter, arg_max(block, (coalesce(chapter, 0), block, last_opened, -replica)) as block, arg_max(last_opened, (coalesce(chapter, 0), block, last_opened, -replica)) as last_opened from b group by all",
    "m11_overwritten": "select s_suppkey as id, s_name as name, floor(s_acctbal)::bigint + case when s_suppkey % 3 <> 1 then 1 else 0 end as size from supplier",
    "m12_merged_weeks": f"with {LONG}, {_REPLICAS}, w as (select replica, user_id, date_trunc('week', day)::date as week, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(distinct document_id) filter (completed) as completed, count(*) as sessions, count(distinct day) as active_days, floor(sum(wpm)::double / count(*) + 0.5::double)::bigint as avg_wpm from replicas group by all) select user_id, week, max(time_ms) as time_ms, max(words) as words, max(completed) as completed, max(sessions) as sessions, max(active_days) as active_days, floor(sum(avg_wpm)::double / count(*) + 0.5::double)::bigint as avg_wpm from w group by all",
    "m12_merged_totals": f"{_S} select user_id, max(t) as time_ms, max(w) as words, max(l) as last_day from (select user_id, replica, sum(duration_ms)::bigint as t, sum(words)::bigint as w, max(day) as l from replicas group by all) group by user_id",
    "m18_sync_outcomes": "select id, case when remote is null then 'uploaded' when same and local = remote then 'no-change' when changes then 'merged' when remote > local then 'downloaded' else 'uploaded' end as action from (select c_custkey as id, c_custkey % 10 as local, case when c_custkey % 7 > 0 then c_custkey % 13 end as remote, c_custkey % 2 = 0 as same, c_custkey % 5 = 0 as changes from customer)",
    "o01_sql_functions": "select doc_id, n as words, case when ms < 3600000 then (ms // 60000) || 'm' when ms // 60000 % 60 = 0 then (ms // 3600000) || 'h' else (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' end as duration, n / 250.0::double as minutes from (select doc_id, n, n * 240 as ms from (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))::bigint as n from documents))",
}
