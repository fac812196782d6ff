"""Queries of item identity, progress, suggestions, imports, replicas, projections and habits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import annotations as J
from lectern.operators import identity as G
from lectern.operators import library as H
from lectern.operators import merge as M
from lectern.operators import stats as K
from lectern.operators import text as D
from lectern.plans import statistics as S
from lectern.plans.library import DEDUP, ITEMS, NORMAL, NOTES, STONES, _both, _gone, _merged
from lectern.sources import bindings as B
from lectern.streaming.live import shared_folder

DEFAULTS = ("Favorites", "Reading list")


def _cached(s, d):
    return B.archive_items(s, d).withColumn("cached", F.col("id") % 4 == 0)


def _chapters(s, d):
    return B.table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), D.word_count(F.col("text")).alias("words"))


def _opened(s, d):
    """Changes to a third of the items."""
    i = B.archive_items(s, d).where("id % 3 = 0")
    return i.select("id", F.date_add("created", 30).alias("opened_at"), F.when(F.col("id") % 2 == 0, F.col("block") + 1).alias("new_block"), F.when(F.col("id") % 5 == 0, F.lit(100).cast("long")).alias("new_percent"))


def _named_collections(s, d):
    return B.archive_items(s, d).where("id % 5 = 0").select("user_id", F.explode("collection_ids").alias("name"))


def _texts(s, d):
    """Annotations with a text, from their color and first word."""
    return B.annotations(s, d).withColumn("text", F.concat_ws("-", "color", (F.col("start_word") % 6).cast("string")))


def _words(s, d):
    """A word of each block of line items, as many as there are, dealt as their join with annotations needs them."""
    n = B.table(s, d, "lineitem")
    return n.select(F.col("l_orderkey").alias("doc_key"), F.col("l_linenumber").cast("long").alias("block"), (F.col("l_partkey") % 60).alias("word")).repartition("doc_key", "block").distinct()


def _pairs(s, d):
    i = B.archive_items(s, d)
    return i.select(
        "id", F.col("collection_ids").alias("a"), F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("a_stamp"), F.when(F.col("id") % 2 == 0, F.array(F.lit("new"))).alias("b"), F.when(F.col("id") % 5 != 0, F.col("id") % 6).alias("b_stamp")
    )


def _sessions(s, d):
    """Sessions that two devices know: each knows two thirds."""
    every = B.sessions(s, d)
    return every.where("event_id % 3 <> 0").withColumn("replica", F.lit(0)).unionByName(every.where("event_id % 3 <> 1").withColumn("replica", F.lit(1)))


def _per_replica(s, d, f):
    every = _sessions(s, d)
    one, two = (f(every.where(F.col("replica") == r)).withColumn("replica", F.lit(r)) for r in (0, 1))
    return one.unionByName(two)


def _merged_library(s, d):
    def held(merged: DataFrame) -> DataFrame:
        merged.write.parquet(folder := shared_folder(s, "m07"))
        return s.read.schema(merged.schema).parquet(folder)

    return M.merged_library(_both(s, d), _gone(s, d)[1], held)


def _note_rows(s, d):
    one = B.annotations(s, d).groupBy("id").agg(F.min("color").alias("color"), F.min("start_word").alias("start_word"), F.min("created").alias("created"))
    a, b = one.where("start_word % 3 <> 0").withColumn("replica", F.lit(0)), one.where("start_word % 3 <> 1").withColumn("replica", F.lit(1))
    return a.unionByName(b.withColumn("color", F.lit("red")).withColumn("created", F.date_add("created", (F.col("start_word") % 2).cast("int"))))


def _stones(s, d):
    stones = _gone(s, d)[1]
    return stones.unionByName(stones.where("user_id % 2 = 0").withColumn("deleted_at", F.date_add("deleted_at", 3)))


def _content(s, d):
    i = B.archive_items(s, d)
    a = i.where("id % 3 <> 0").select("id", "title", F.when(F.col("id") % 2 == 0, F.concat(F.lit("local "), "title")).alias("content"))
    b = i.where("id % 3 <> 1").select("id", F.upper("title").alias("title"), F.lit("remote").alias("content"))
    return a, b


def _backlog(s, d):
    return H.progress_breakdown(B.archive_items(s, d)).select("user_id", (F.col("in_progress") + F.col("unread")).alias("backlog"))


def _kpis(s, d):
    """What the habit scores are made from, a row for each user with sessions."""
    daily, sessions = S._daily(s, d), B.sessions(s, d)
    kinds = B.archive_items(s, d).groupBy("user_id").agg(F.count_distinct("type").alias("types"))
    rows = K.lifetime_totals(daily).select("user_id", "annotations").join(K.streaks(daily).select("user_id", "current_streak"), "user_id")
    rows = rows.join(K.average_wpm(K.wpm_history(sessions)), "user_id").join(K.daily_average(daily), "user_id").join(K.finish_rate(sessions).select("user_id", "finish_rate"), "user_id")
    return rows.join(kinds, "user_id", "left").na.fill(0, ["types"])


def _goal_changes(s, d):
    e = B.table(s, d, "events").where("event_type = 'signup'")
    return e.select("user_id", "ts", "event_id", (F.col("event_id") % 90).alias("daily_minutes"))


def _notes_with_text(s, d, by_document=False):
    """Annotations with a text that holds signs of markup, and notes with space around them."""
    text = F.concat(F.lit("<b>"), "color", F.lit("</b> & \"it's\" "), F.col("start_word").cast("string"))
    return B.annotations(s, d, by_document).withColumns({"text": text, "note": F.when(F.col("start_word") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "note", F.lit(" ")))})


def _export_files(s, d):
    titles = B.archive_items(s, d).select(F.col("id").alias("doc_key"), "title")
    return J.exported_files(_notes_with_text(s, d, by_document=True).join(titles, "doc_key", "left"), J.FORMATS, B.AS_OF)


QUERIES = {
    "a08_export_files": _export_files,
    "a08_copied_notes": lambda s, d: _notes_with_text(s, d).select("id", J.copied().alias("copied")),
    "a08_exported_notes": lambda s, d: J.exported_lines(B.annotations(s, d, by_document=True)),
    "a10_import_counts": lambda s, d: J.import_counts(_texts(s, d).where("start_block % 2 = 0"), _texts(s, d).where("start_block % 2 = 1")),
    "f07_suggestions": lambda s, d: H.suggestions(B.archive_items(s, d), "an"),
    "f08_tag_suggestions": lambda s, d: J.tag_suggestions(B.annotations(s, d), "", used=("A",)),
    "g02_url_hash": lambda s, d: B.table(s, d, "pages").select("page_id", G.string_hash(F.col("url")).alias("hash")),
    "g03_text_hash": lambda s, d: B.table(s, d, "documents").select("doc_id", G.text_hash(F.col("text")).alias("hash")),
    "g04_stable_id": lambda s, d: B.archive_items(s, d).select("id", G.stable_id(F.col("type"), F.col("file_hash"), F.col("url"), F.col("title")).alias("stable_id")),
    "h06_with_notes": lambda s, d: H.with_notes(B.archive_items(s, d), B.annotations(s, d).select(F.col("doc_key").alias("id"))).select("id", "title"),
    "k25_charts": lambda s, d: K.charts(S._series(s, d, 30), K.wpm_history(B.sessions(s, d)), B.AS_OF),
    "h06_long_reads": lambda s, d: B.archive_items(s, d).where(F.col("word_count") >= H.LONG_READ).select("id", "word_count"),
    "h12_cache_stats": lambda s, d: H.cache_stats(_cached(s, d)),
    "h13_book_progress": lambda s, d: H.book_progress(_chapters(s, d).select("book", "chapter", (F.col("book") % 4).alias("block"), F.lit(4).cast("long").alias("blocks")), _chapters(s, d)),
    "h15_touched": lambda s, d: H.touched(B.archive_items(s, d), _opened(s, d)),
    "h18_sync_status": lambda s, d: _cached(s, d).select("id", H.sync_status(F.col("type"), F.col("cached"), F.col("url"), F.when(F.col("id") % 7 != 0, F.col("title"))).alias("status")),
    "h19_visible_selection": lambda s, d: B.archive_items(s, d).where("type = 'web'").join(B.archive_items(s, d).where("id % 10 < 5").select("id"), "id", "left_semi").groupBy("user_id").agg(F.count("*").alias("selected")),
    "i04_collection_catalog": lambda s, d: H.collection_catalog(B.archive_items(s, d).select("user_id").distinct(), _named_collections(s, d), DEFAULTS),
    "j01_with_items": lambda s, d: J.with_items(B.annotations(s, d), B.archive_items(s, d).select((F.col("id") - F.col("id") % 2).alias("key"), "title", "type", "last_opened", "id")),
    "j07_at_words": lambda s, d: J.at_words(_words(s, d), B.annotations_by_block(s, d)),
    "k21_projections": lambda s, d: K.projections(B.sessions(s, d), S._daily(s, d), _backlog(s, d), B.AS_OF),
    "k25_sparklines": lambda s, d: K.sparklines(S._series(s, d, 7)),
    "k26_habit_scores": lambda s, d: K.habit_scores(_kpis(s, d)),
    "k28_current_goals": lambda s, d: K.current_goals(_goal_changes(s, d)),
    "m03_merged_membership": lambda s, d: M.merged_membership(_pairs(s, d)),
    "m05_merged_tombstones": lambda s, d: M.merged_tombstones(_stones(s, d)),
    "m07_merged_library": lambda s, d: _merged_library(s, d),
    "m10_merged_annotations": lambda s, d: M.newest_rows(_note_rows(s, d), ["id"], "created").select("id", "color", "created"),
    "m12_merged_days": lambda s, d: M.merged_daily(_sessions(s, d)),
    "m12_merged_hours": lambda s, d: M.merged_hours(_sessions(s, d)),
    "m12_merged_wpm": lambda s, d: M.merged_wpm(_per_replica(s, d, K.wpm_history)),
    "m13_better_bests": lambda s, d: M.better_bests(_per_replica(s, d, K.personal_bests)),
    "m16_applied": lambda s, d: M.applied(*_content(s, d)),
}

_I, _N = f"with {ITEMS}", f"with {NOTES}"
_MARKED = """texts as (select * replace (case when start_word % 4 = 0 then '  ' else ' ' || note || ' ' end as note), '<b>' || color || '</b> & "it''s" ' || start_word as text from notes)"""
_NOTE = "trim(coalesce(note, ''))"
_COPIED = f"concat('\"', text, '\"', case when {_NOTE} <> '' then chr(10) || 'Note: ' || {_NOTE} else '' end)"


def _escaped(c: str) -> str:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        c = f"replace({c}, '{sign}', '{entity}')"
    return c

_URL_HASH = "lower(to_base(abs(list_reduce(list_transform(string_split({}, ''), lambda c: unicode(c)::bigint), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::bigint)), 36))"


def _djb(text: str) -> str:
    one, two = (f"abs(list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::bigint), lambda h, c: xor(((h * 33 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, c), {seed}::bigint))" for seed in (5381, 52711))
    return f"lpad(lower(to_hex({one} * 4096 + {two})), 16, '0')"


_TEXTS = f"{NOTES}, texts as (select *, color || '-' || (start_word % 6) as text from notes)"
_CHAPTERS = r"chapters as (select conv_id as book, turn as chapter, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::bigint as words, conv_id % 4 as block from conversations)"
_BOTH_ROWS = "both_rows as (select * from items where id % 3 <> 0 union all by name select * replace ((percent + 17) % 101 as percent, (block + 5) % 40 as block, case when id % 2 = 0 then last_opened + 1 else last_opened end as last_opened) from items where id % 3 <> 1)"
_TWO = f"{S.SESSIONS}, two as (select *, 0 as replica from sessions where event_id % 3 <> 0 union all select *, 1 from sessions where event_id % 3 <> 1)"
_BESTS = """b as (select replica, user_id, max(duration_ms) as longest_ms, arg_max(day, (duration_ms, -epoch_us(ts))) as longest_day, max(wpm) filter (duration_ms >= 60000) as fastest_wpm, arg_max(day, (wpm, -epoch_us(ts))) filter (duration_ms >= 60000) as fastest_day from two group by all),
w as (select replica, user_id, max(words)::bigint as most_words, arg_max(day, (words, -epoch_us(day::timestamp))) as most_words_day from (select replica, user_id, day, sum(words) as words from two group by all) group by all), r as (select * from b join w using (replica, user_id))"""
_half = lambda x: f"floor({x} + 0.5::double)::bigint"
_best = lambda v, d: f"max({v}) as {v}, arg_max({d}, ({v}, -replica)) filter ({v} is not null) as {d}"

ORACLE_SQL = {
    "a08_copied_notes": f"{_I}, {NOTES}, {_MARKED} select id, {_COPIED} as copied from texts",
    "a08_export_files": f"""{_I}, {NOTES}, {_MARKED}, placed as (select t.*, coalesce(i.title, 'Untitled') as title, row_number() over w as place, count(*) over (partition by doc_key) as n from texts t left join items i on i.id = t.doc_key window w as (partition by doc_key order by start_block, start_word, t.id)),
md as (select doc_key, unnest(case when place = 1 then [{{'place': 0, 'part': '# Highlights from "' || title || '"' || chr(10)}}] else [] end || [{{'place': place, 'part': concat('## Highlight ', place, chr(10), '> "', text, '"', chr(10), case when {_NOTE} <> '' then chr(10) || '**Note:** ' || {_NOTE} || chr(10) else '' end, case when place < n then chr(10) || '---' || chr(10) else '' end)}}]) as p from placed),
txt as (select doc_key, unnest(case when place = 1 then [{{'place': 0, 'part': 'Highlights from "' || title || '"' || chr(10)}}] else [] end || [{{'place': place, 'part': concat('---', chr(10), chr(10), {_COPIED}, case when place < n then chr(10) else '' end)}}]) as p from placed),
html as (select doc_key, unnest(case when place = 1 then [{{'place': 0, 'part': concat('<!DOCTYPE html>', chr(10), '<html lang="en"><head><meta charset="UTF-8"><title>Highlights from "', {_escaped('title')}, '"</title></head>', chr(10), '<body><h1>Highlights from "', {_escaped('title')}, '"</h1>', chr(10), '<p>', n, case when n = 1 then ' highlight' else ' highlights' end, ' · Exported ', strftime(date '{B.AS_OF}', '%B %-d, %Y'), '</p>', chr(10), '<ol>')}}] else [] end
 || [{{'place': place, 'part': concat('<li>', case when favorite then '★' else '' end, '<blockquote style="border-left: 4px solid ', {_escaped('color')}, '">"', {_escaped('text')}, '"</blockquote>', case when {_NOTE} <> '' then '<p class="note">' || {_escaped(_NOTE)} || '</p>' else '' end, '<small>', strftime(created, '%B %-d, %Y'), '</small></li>')}}] || case when place = n then [{{'place': place + 1, 'part': '</ol></body></html>'}}] else [] end) as p from placed),
js as (select doc_key, unnest(case when place = 1 then [{{'place': 0, 'part': concat('{{', chr(10), '  "documentTitle": ', to_json(title), ',', chr(10), '  "exportedAt": "{B.AS_OF}T00:00:00.000Z",', chr(10), '  "annotations": [')}}] else [] end
 || [{{'place': place, 'part': concat('    {{', chr(10), '      "text": ', to_json(text), ',', chr(10), '      "note": ', coalesce(to_json(nullif(note, ''))::varchar, 'null'), ',', chr(10), '      "color": ', to_json(color), ',', chr(10), '      "isFavorite": ', favorite, ',', chr(10), '      "tags": ', case when tags is null then '[]' else concat('[', chr(10), '        ', array_to_string(list_transform(tags, lambda x: to_json(x)::varchar), ',' || chr(10) || '        '), chr(10), '      ]') end, ',', chr(10), '      "createdAt": "', strftime(created, '%Y-%m-%d'), 'T00:00:00.000Z"', chr(10), '    }}', case when place < n then ',' else '' end)}}]
 || case when place = n then [{{'place': place + 1, 'part': concat('  ]', chr(10), '}}')}}] else [] end) as p from placed)
select format, doc_key, p.place::bigint as place, p.part as part from (select 'markdown' as format, * from md union all select 'text', * from txt union all select 'html', * from html union all select 'json', * from js)""",
    "a08_exported_notes": f"{_N} select doc_key, id, row_number() over (partition by doc_key order by start_block, start_word, id) || '. **' || color || '**' || case when favorite then ' *' else '' end || coalesce(': ' || note, '') as line from notes",
    "a10_import_counts": f"with {_TEXTS}, b as (select doc_key, text, count(*) as n from texts where start_block % 2 = 1 group by all), j as (select b.*, exists (select 1 from texts t where t.start_block % 2 = 0 and t.doc_key = b.doc_key and t.text = b.text) as known from b) select doc_key, count(*) filter (not known) as imported, sum(case when known then n else n - 1 end)::bigint as skipped from j group by doc_key",
    "f07_suggestions": f"{_I}, r as (select user_id, id, last_opened, unnest([0, 1, 2]) as field, unnest(['title', 'author', 'source_label']) as kind, unnest([title, author, source_label]) as text from items), o as (select * from r where contains(lower(text), 'an') qualify row_number() over (partition by user_id, text order by last_opened desc, id, field) = 1), n as (select user_id, kind, text, row_number() over (partition by user_id order by last_opened desc, id, field, text) as place from o) select * from n where place <= 8",
    "f08_tag_suggestions": f"{_N} select tag, count(*) as n from (select unnest(tags) as tag from notes) where tag not in ('A', '') group by tag order by n desc, tag limit 5",
    "g02_url_hash": f"select page_id, {_URL_HASH.format('url')} as hash from pages",
    "g03_text_hash": f"select doc_id, {_djb('text')} as hash from documents",
    "g04_stable_id": f"{_I} select id, coalesce('file_' || type || '_' || file_hash, 'web_' || {_URL_HASH.format(NORMAL.format('url'))}, 'paste_' || {_djb('title')}) as stable_id from items",
    "h06_with_notes": f"{_I}, {NOTES} select id, title from items where id in (select doc_key from notes)",
    "k25_charts": f"""with {S.DAILY}, {S.SERIES.format(a=B.AS_OF, n=29)}, {S.HISTORY}, c as (select s.user_id, s.day, floor(time_ms / 60000.0::double + 0.5::double)::bigint as minutes, words, avg_wpm as wpm, date_diff('day', s.day, date '{B.AS_OF}') as age from series s left join history h on h.user_id = s.user_id and h.day = s.day)
select user_id, day, case when age < 14 then minutes end as minutes, case when age < 14 then words end as words, wpm, age < 7 as in_sparkline from c""",
    "h06_long_reads": f"{_I} select id, word_count from items where word_count >= 10000",
    "h12_cache_stats": f"{_I}, c as (select user_id, count(*) as n from items where type = 'web' and percent < 95 and id % 4 <> 0 group by user_id), t as (select user_id, count(*) as items, count(*) filter (id % 4 = 0) as cached_items from items group by user_id) select user_id, items, cached_items, least(3, coalesce(n, 0)) as candidates from t left join c using (user_id)",
    "h13_book_progress": f"with {_CHAPTERS}, p as (select *, coalesce(sum(words) over (partition by book order by chapter rows between unbounded preceding and 1 preceding), 0) as earlier, sum(words) over (partition by book) as total, count(*) over (partition by book) as n from chapters), q as (select book, chapter, n, floor(case when n > 1 and total > 0 then (earlier + words * ((block + 1) / 4.0::double)) / total::double else (block + 1) / 4.0::double end * 100 + 0.5::double)::bigint as percent from p) select book, chapter, percent, case when n > 1 then 'Ch ' || (chapter + 1) || ' of ' || n || ' (' || percent || '%)' else percent || '%' end as label from q",
    "h15_touched": f"{_I} select id, user_id, case when id % 3 = 0 then greatest(last_opened, created + 30) else last_opened end as last_opened, case when id % 6 = 0 then block + 1 else block end as block, case when id % 15 = 0 then 100 else percent end as percent from items",
    "h18_sync_status": f"{_I} select id, case when case when type in ('pdf', 'epub', 'mobi', 'docx') then id % 4 = 0 when type = 'web' then url is not null else id % 7 <> 0 end then 'synced' else 'not-synced' end as status from items",
    "h19_visible_selection": f"{_I} select user_id, count(*) as selected from items where type = 'web' and id % 10 < 5 group by user_id",
    "i04_collection_catalog": f"{_I}, own as (select distinct user_id, unnest(collection_ids) as name from items where id % 5 = 0) select * from own union all select user_id, unnest(['Favorites', 'Reading list']) from (select distinct user_id from items) where user_id not in (select user_id from own)",
    "j01_with_items": f"{_I}, {NOTES}, once as (select id - id % 2 as doc_key, arg_max(title, (last_opened, id)) as title, arg_max(type, (last_opened, id)) as item_type from items group by 1) select n.id, n.doc_key, title, item_type from notes n left join once using (doc_key)",
    "j07_at_words": f"{_N.replace('l_quantity from', 'l_quantity, start_word + l_quantity::int as end_word from')}, w as (select distinct l_orderkey as doc_key, l_linenumber as block, l_partkey % 60 as word from lineitem), j as (select w.*, n.id, n.color, n.start_block, n.start_word from w join notes n on w.doc_key = n.doc_key and (w.block > n.start_block or (w.block = n.start_block and w.word >= n.start_word)) and (w.block < n.end_block or (w.block = n.end_block and w.word <= n.end_word))) select doc_key, block, word, id, color, count(*) over (partition by doc_key, block, word) as n from j qualify row_number() over (partition by doc_key, block, word order by start_block, start_word, id, color) = 1",
    "k21_projections": f"""with {S.DAILY}, {ITEMS}, r as (select user_id, {S._rolled(30)} from sessions where day between date '{B.AS_OF}' - 29 and date '{B.AS_OF}' group by user_id),
l as (select user_id, sum(completed)::bigint as recent from daily where day between date '{B.AS_OF}' - 89 and date '{B.AS_OF}' group by user_id), t as (select user_id, sum(completed)::bigint as c, sum(words)::bigint as w from daily group by user_id), k as (select user_id, count(*) filter (percent < 100) as backlog from items group by user_id),
j as (select r.user_id, minutes_30, words_30, coalesce(recent, 0) as recent, coalesce(recent, 0) / 90.0::double as rate, c, w, coalesce(backlog, 0) as backlog from r left join l using (user_id) join t using (user_id) left join k using (user_id))
select user_id, {_half('minutes_30 * 365 / 60.0::double')} as hours_per_year, words_30 * 365 as words_per_year, case when recent >= 3 then {_half('rate * 365')} else {_half('words_30 * 365 / 50000.0::double')} end as books_per_year, case when recent >= 3 then 'completion-rate' else 'reading-pace' end as based_on,
 case when minutes_30 < 15 then 'low' when recent >= 3 then 'high' else 'medium' end as confidence, case when rate > 0 then {_half('backlog / rate')} end as backlog_days, case when rate > 0 then {_half('1 / rate')} end as next_book_days, case when c < 100 and rate > 0 then {_half('(100 - c) / rate')} end as hundred_books_days,
 case when w < 1000000 and words_30 > 0 then {_half('(1000000 - w) / words_30::double')} end as million_words_days from j""",
    "k25_sparklines": f"with {S.DAILY}, {S.SERIES.format(a=B.AS_OF, n=6)}, m as (select user_id, day, floor(time_ms / 60000.0::double + 0.5::double)::bigint as m from series) select user_id, string_agg(m::varchar, ',' order by day) as minutes, max(m) as most from m group by user_id",
    "k26_habit_scores": f"""with {S.DAILY}, {S.HISTORY}, {ITEMS}, runs as (select user_id, count(*) as days, max(day) as last from (select user_id, day, day - row_number() over (partition by user_id order by day)::int as run from daily) group by user_id, run), s as (select user_id, arg_max(days, last) as streak from runs group by user_id),
a as (select user_id, {_half('sum(avg_wpm * sessions)::double / sum(sessions)')} as wpm from history group by user_id), d as (select user_id, {S._AVG.format(a='sum(time_ms)', b='count(*) filter (time_ms > 0)', c='/ 60000.0')} as minutes, sum(annotations)::bigint as notes from daily group by user_id),
f as (select user_id, {_half('count(distinct document_id) filter (completed) * 100::double / count(distinct document_id)')} as rate from sessions group by user_id), t as (select user_id, count(distinct type) as types from items group by user_id),
j as (select * from s join a using (user_id) join d using (user_id) join f using (user_id) left join t using (user_id))
select user_id, unnest(['Consistency', 'Speed', 'Volume', 'Variety', 'Completion', 'Engagement']) as habit, unnest([least(100, streak * 10), least(100, {_half('wpm / 400.0::double * 100')}), least(100, {_half('minutes / 60.0::double * 100')}), least(100, coalesce(types, 0) * 25), rate, least(100, {_half('notes / 50.0::double * 100')})]) as score from j""",
    "k28_current_goals": "select user_id, arg_max(event_id % 90, (ts, event_id)) as daily_minutes from events where event_type = 'signup' group by user_id",
    "m03_merged_membership": f"{_I}, p as (select id, coalesce(collection_ids, []) as a, case when id % 4 <> 0 then id % 7 end as s, case when id % 2 = 0 then ['new'] else [] end as b, case when id % 5 <> 0 then id % 6 end as t from items), c as (select id, case when s is not null and (t is null or s >= t) then a when t is not null then b else list_distinct(list_concat(a, b)) end as c, greatest(s, t) as stamp from p) select id, case when len(c) > 0 then array_to_string(list_sort(c), ',') end as collections, stamp from c",
    "m05_merged_tombstones": f"{_I}, {STONES} select user_id, key, case when user_id % 2 = 0 then date '{B.AS_OF_LONG}' + 3 else date '{B.AS_OF_LONG}' end as deleted_at from stones where key is not null",
    "m07_merged_library": f"{_I}, {_BOTH_ROWS}, {DEDUP.replace('from items', 'from both_rows')}, {STONES}, {_merged('(select *, id as id_key from once)', 'id_key', 'by_id')} select i.* exclude (merged_rows) from by_id i where not exists (select 1 from stones s where s.user_id = i.user_id and s.key in (i.id::varchar, 'hash:' || i.file_hash, 'url:' || {NORMAL.format('i.url')}))",
    "m10_merged_annotations": f"{_N}, one as (select id, min(color) as color, min(start_word) as start_word, min(created) as created from notes group by id), b as (select id, color, created, 0 as r from one where start_word % 3 <> 0 union all select id, 'red', created + (start_word % 2)::int, 1 from one where start_word % 3 <> 1) select id, color, created from b qualify row_number() over (partition by id order by created desc, r desc) = 1",
    "m12_merged_days": f"with {_TWO}, own as (select replica, user_id, day, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words from two group by all), m as (select user_id, day, max(time_ms) as time_ms, max(words) as words from own group by all) select * from m join (select user_id, day, count(distinct document_id) as opened, count(distinct document_id) filter (completed) as completed from two group by all) using (user_id, day)",
    "m12_merged_hours": f"with {_TWO}, own as (select replica, user_id, hour(ts) as hour, sum(duration_ms)::bigint as time_ms, count(*) as sessions from two group by all) select user_id, hour, max(time_ms) as time_ms, max(sessions) as sessions from own group by user_id, hour",
    "m12_merged_wpm": f"with {_TWO}, own as (select replica, user_id, day, floor(sum(wpm)::double / count(*) + 0.5)::bigint as avg_wpm, count(*) as sessions from two group by all) select user_id, day, avg_wpm, sessions from own qualify row_number() over (partition by user_id, day order by sessions desc, replica) = 1",
    "m13_better_bests": f"with {_TWO}, {_BESTS} select user_id, {_best('longest_ms', 'longest_day')}, {_best('fastest_wpm', 'fastest_day')}, {_best('most_words', 'most_words_day')} from r group by user_id",
    "m16_applied": f"{_I} select id, case when id % 3 = 1 then title else upper(title) end as title, case when id % 3 <> 0 and id % 2 = 0 then 'local ' || title end as content from items",
}
