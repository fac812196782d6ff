"""Queries of typed blocks, chapters, layout, emphasis, pacing, search positions and web pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import blocks as X
from lectern.operators import language as E
from lectern.operators import pages as C
from lectern.operators import text as D
from lectern.plans import language as L
from lectern.plans.corpus import searched
from lectern.plans.statistics import SESSIONS
from lectern.sources import bindings as B

HEADING_PAUSE = 1.5


def _blocks(s, d):
    return X.typed_blocks(B.table(s, d, "documents"))


def _sections(s, d):
    return B.table(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("section"), D.word_count(F.col("text")).alias("words"), "role")


def _chapters(s, d):
    rows = _sections(s, d).withColumnRenamed("section", "chapter")
    return X.kept_chapters(rows.withColumn("label", F.when(F.col("chapter") % 2 == 0, F.col("role"))))


def _toc(s, d):
    """A table of contents that covers all chapters of some books, few of others."""
    return _chapters(s, d).where("book % 3 = 0 or number % 4 = 1").select("book", "number", F.upper("title").alias("title"))


def _lines(s, d):
    """Lines of documents as a layout would give them."""
    rows = B.table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    n = F.col("line")
    size = F.when(n == 0, 22.0).when(n % 7 == 0, 14.0).otherwise(12.0)
    mark = F.when(n % 6 == 2, F.concat(F.lit("- "), "raw")).when(n % 6 == 3, F.concat(F.lit("1. "), "raw")).otherwise(F.col("raw"))
    return rows.select("doc_id", n.cast("long").alias("line"), F.when(n % 5 == 4, "").otherwise(mark).alias("text"), size.alias("font_size"), (n % 11 == 0).alias("bold"))


def _emphasised(s, d):
    words = L._vocabulary(s, d).select("word", "language", E.tier().alias("tier"))
    cut = lambda p: F.substring(F.col("word"), F.lit(1), X.bold_length(F.col("word"), p))
    return words.select("word", "language", cut(F.lit(X.EMPHASIS)).alias("bold"), cut(X.adaptive_proportion(F.col("tier"))).alias("adaptive_bold"))


def _matches(s, d):
    return D.phrase_matches(B.table(s, d, "documents"), B.PHRASES)


def _block_scores(s, d):
    return E.readability(L._paragraph_texts(s, d), "doc_id", "block")


def _pages(s, d):
    return B.table(s, d, "pages")


QUERIES = {
    "b05_plain_texts": lambda s, d: X.plain_texts(_blocks(s, d)),
    "b06_article_blocks": lambda s, d: X.article_blocks(_blocks(s, d)).select("doc_id", "block"),
    "b09_selected_blocks": lambda s, d: X.article_blocks(_blocks(s, d), strict=False).select("doc_id", "block"),
    "b10_layout_blocks": lambda s, d: X.layout_blocks(_lines(s, d)),
    "b11_heading_chapters": lambda s, d: X.heading_chapters(_blocks(s, d)),
    "b12_merged_sections": lambda s, d: X.merged_sections(_sections(s, d)),
    "b13_kept_chapters": lambda s, d: _chapters(s, d),
    "b14_flat_toc": lambda s, d: X.flat_toc(_toc(s, d), _chapters(s, d)),
    "b15_first_headings": lambda s, d: X.first_headings(_blocks(s, d)),
    "c01_page_blocks": lambda s, d: C.judged_blocks(_pages(s, d)),
    "c09_page_metadata": lambda s, d: _pages(s, d).select("page_id", *C.metadata()),
    "c10_unsafe_markup": lambda s, d: _pages(s, d).select("page_id", C.unsafe_tags().alias("tags"), C.has_script_link().alias("script_link")),
    "c06_article_markup": lambda s, d: C.article_rows(_pages(s, d)),
    "c11_removal_log": lambda s, d: C.removal_log(_pages(s, d)),
    "c11_removals": lambda s, d: C.removals(_pages(s, d)),
    "c12_articles": lambda s, d: C.articles(_pages(s, d)),
    "d07_sentence_pauses": lambda s, d: D.sentence_tokens(B.table(s, d, "documents")).select("doc_id", "sentence", D.sentence_pause(F.col("text")).alias("pause")),
    "d15_pacing": lambda s, d: X.pacing(E.readability(L._paragraph_texts(s, d), "doc_id", "block"), L.WPM),
    "d15_word_pacing": lambda s, d: X.paced_words(_blocks(s, d), _block_scores(s, d), L.WPM, HEADING_PAUSE),
    "d15_sentence_pacing": lambda s, d: X.paced_sentences(_blocks(s, d), _block_scores(s, d), L.WPM, HEADING_PAUSE),
    "d16_emphasis": _emphasised,
    "d16_speed_emphasis": lambda s, d: B.sessions(s, d).select("event_id", (F.col("wpm") * 2).alias("wpm"), X.proportion_at(F.col("wpm") * 2).alias("proportion")),
    "f04_matches_at": lambda s, d: X.matches_at(None, _matches(s, d), "phrase"),
    "f05_neighbour_matches": lambda s, d: X.neighbour_matches(_matches(s, d), "phrase"),
    "h14_time_remaining": lambda s, d: X.time_remaining(L._offsets(s, d), L.WPM),
}

_any = lambda text, patterns: "(" + " or ".join(f"regexp_matches({text}, '(?i){p}')" for p in patterns) + ")"
_trim = lambda text: rf"regexp_replace(regexp_replace({text}, '^\s+', ''), '\s+$', '')"
_TYPED = rf"parts as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: {_trim('x')}), lambda x: x <> '') as p from documents), raw as (select doc_id, unnest(range(len(p))) as block, unnest(p) as content from parts), blocks as (select doc_id, block, case when length(content) < 40 and content not like '%.' then 'heading' else 'paragraph' end as type, case when length(content) < 40 and content not like '%.' then length(content) % 3 + 1 end as level, content from raw)"
_CONTROL = rf"({_any('content', X.CONTROLS)} or regexp_matches(content, '(?i)^[a-z↑↓←→]+$') or regexp_matches(content, '^[+\-=/\\?!]+$')"


def _article(strict: str) -> str:
    return f"with {_TYPED} select doc_id, block from blocks where not {_any('content', X.NON_ARTICLE)} and not case when type = 'heading' then {_any('content', X.CONTROLS)} else {_CONTROL}{strict}) end"


_SECTIONS = r"sections as (select conv_id as book, turn as section, role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::bigint as words from conversations)"
_KEPT = f"{_SECTIONS}, first_one as (select *, row_number() over (partition by book order by section) = 1 as first from sections), kept as (select book, row_number() over (partition by book order by section) as number, section as chapter, words, role from first_one where first or words >= 20), titled as (select book, number, chapter, words, case when chapter % 2 = 0 then role else 'Chapter ' || number end as title from kept)"
_FOUND = searched("documents", "doc_id")
_label = lambda m: f"case when {m} < 1 then floor({m} * 60 + 0.5::double)::bigint || 's' when {m} < 60 then floor({m} + 0.5::double)::bigint || 'm' else floor({m} / 60)::bigint || 'h' || case when floor({m} % 60 + 0.5::double) > 0 then ' ' || floor({m} % 60 + 0.5::double)::bigint || 'm' else '' end end"
_cut = lambda p: f"substr(word, 1, least(length(word), greatest(1, case when length(word) <= 3 then floor(length(word) * {p}) else floor(length(word) * {p} + 0.5::double) end))::bigint)"
_meta = lambda name: f"""nullif(regexp_extract(html, '<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), '')"""
_LINES = r"""cut as (select doc_id, string_split(text, chr(10)) as p from documents), raws as (select doc_id, unnest(range(len(p))) as line, unnest(p) as raw from cut),
lines as (select doc_id, line, case when line % 5 = 4 then '' when line % 6 = 2 then '- ' || raw when line % 6 = 3 then '1. ' || raw else raw end as text, case when line = 0 then 22.0 when line % 7 = 0 then 14.0 else 12.0 end::double as font_size, line % 11 = 0 as bold from raws)"""
_NUMBER = X.NUMBER

ORACLE_SQL = {
    "b05_plain_texts": f"with {_TYPED} select doc_id, string_agg(content, ' ' order by block) as text, count(*) as blocks from blocks group by doc_id",
    "b06_article_blocks": _article(f" or length(content) < {X.LEAST_CHARS} or length(regexp_replace(content, '[^a-zA-ZæøåÆØÅ]', '', 'g')) < length(content) * {X.LEAST_LETTERS}::double"),
    "b09_selected_blocks": _article(""),
    "b10_layout_blocks": rf"""with {_LINES}, sizes as (select doc_id, floor(font_size * 2 + 0.5::double) / 2 as size, count(*) as n, min(line) as first from lines where text <> '' group by all), body as (select doc_id, arg_max(size, (n, -first)) as body from sizes group by doc_id),
k as (select doc_id, line, font_size / body as ratio, bold, text, case when text = '' then 'gap' when regexp_matches(text, '{X.BULLET}') then 'bullets' when regexp_matches(text, '{_NUMBER}') then 'numbers' when (font_size / body >= 1.15::double or bold) and length(text) < 100 then 'heading' else 'paragraph' end as kind from lines join body using (doc_id)),
r as (select *, case when kind = 'heading' or lag(kind) over (partition by doc_id order by line) is null or kind <> lag(kind) over (partition by doc_id order by line) then 1 else 0 end as opens from k), g as (select *, sum(opens) over (partition by doc_id order by line) as run from r),
f as (select doc_id, run, kind, min(case when ratio >= 1.8::double or (ratio >= 1.5::double and bold) then 1 when ratio >= 1.4::double then 2 when ratio >= 1.2::double or bold then 3 else 4 end) as level, string_agg(case when kind = 'bullets' then regexp_replace(text, '{X.BULLET}', '') when kind = 'numbers' then regexp_replace(text, '{_NUMBER}', '') else text end, ' ' order by line) as content from g where kind <> 'gap' group by all)
select doc_id, row_number() over (partition by doc_id order by run) - 1 as block, kind as type, case when kind = 'heading' then level end as level, {_trim('content')} as content from f""",
    "b11_heading_chapters": rf"""with {_TYPED}, r as (select *, (coalesce(level <= 2, false) and row_number() over (partition by doc_id order by block) > 1)::int as opens, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) as n from blocks), g as (select *, sum(opens) over (partition by doc_id order by block) as part from r),
p as (select doc_id, part, arg_min(content, block) as first, (sum(length(content)) + count(*) - 1)::bigint as chars, sum(n)::bigint as words from g group by all), k as (select *, max(part) over (partition by doc_id) as last from p)
select doc_id, row_number() over (partition by doc_id order by part) - 1 as chapter, case when part = 0 then 'Beginning' else first end as title, chars, words from k where chars > 100 or part = last""",
    "b12_merged_sections": f"with {_SECTIONS}, o as (select *, row_number() over (partition by book order by section) = 1 as head from sections), r as (select *, sum((words >= 50 or head)::int) over (partition by book order by section) - 1 as chapter from o) select book, chapter::bigint as chapter, min(section) as first_section, count(*) as sections, sum(words)::bigint as words from r group by all",
    "b13_kept_chapters": f"with {_KEPT} select * from titled",
    "b14_flat_toc": f"with {_KEPT}, toc as (select book, number, upper(title) as title from titled where book % 3 = 0 or number % 4 = 1), poor as (select book from (select book, count(*) as own from titled group by book) left join (select book, count(*) as given from toc group by book) using (book) where coalesce(given, 0) * 2 < own) select * from toc where book not in (from poor) union all select book, number, title from titled where book in (from poor)",
    "b15_first_headings": f"with {_TYPED} select doc_id, arg_min(content, block) as heading from blocks where type = 'heading' group by doc_id",
    "c09_page_metadata": rf"select page_id, coalesce(nullif(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g'), ''), 'Untitled') as title, {_meta('author')} as author, coalesce({_meta('og:image')}, {_meta('twitter:image')}) as image from pages",
    "c10_unsafe_markup": f"select page_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))), lambda t: not list_contains([{', '.join(repr(t) for t in C.ALLOWED)}], t))), ',') as tags, regexp_matches(html, '(?i)href\\s*=\\s*[\"'']?\\s*javascript:') as script_link from pages",
    "d07_sentence_pauses": L.ORACLE_SQL["d02_sentence_tokens"].split("select doc_id, i as sentence")[0] + r"select doc_id, i as sentence, (case when contains(text, '!') then 2.0 when contains(text, '?') then 1.8 when regexp_matches(text, '\.{2,}|…') then 2.5 else 2.0 end)::double as pause from o where text <> ''",
    "d15_pacing": f"with {L._BLOCKS}, {L._scores('blocks', 'doc_id, block')}, t as (select doc_id, block, floor(wpm_factor * {L.WPM} + 0.5::double)::bigint as speed, words from scores), m as (select doc_id, block, speed, greatest(500, floor(words::double / speed * 60000.0::double + 0.5::double)::bigint) as ms from t) select *, coalesce(sum(ms) over (partition by doc_id order by block rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from m",
    "d16_emphasis": f"with {L._WORDS}, p as (select word, language, greatest(0.2::double, least(0.6::double, ([{', '.join(f'{v}::double' for v in X.EMPHASIS_BY_TIER)}])[tier] * {X.EMPHASIS}::double)) as part from tiered) select word, language, {_cut('0.4::double')} as bold, {_cut('part')} as adaptive_bold from p",
    "f04_matches_at": f"with {_FOUND}, n as (select *, row_number() over (partition by doc_id, phrase order by start_word) - 1 as match from found), t as (select doc_id, phrase, start_word, match, unnest(range(start_word, end_word + 1)) as word from n) select doc_id, phrase, word, min(match) as match, word = min(start_word) as starts from t group by doc_id, phrase, word",
    "f05_neighbour_matches": f"with {_FOUND} select doc_id, phrase, start_word, coalesce(lead(start_word) over o, min(start_word) over (partition by doc_id, phrase)) as next_start, coalesce(lag(start_word) over o, max(start_word) over (partition by doc_id, phrase)) as previous_start from found window o as (partition by doc_id, phrase order by start_word)",
    "h14_time_remaining": f"with {L._OFFSETS}, t as (select doc_id, block, (sum(words) over (partition by doc_id) - start) / {L.WPM}.0::double as m, sum(words) over (partition by doc_id) / {L.WPM}.0::double as n from offsets) select doc_id, block, {_label('m')} as remaining, {_label('n')} as total from t",
}
_BLOCK_SPEEDS = f"speeds as (with {L._BLOCKS}, {L._scores('blocks', 'doc_id, block')} select doc_id, block, floor(wpm_factor * {L.WPM} + 0.5::double)::bigint as speed from scores)"
_LAST_PAUSE = f"case when unit = u.n - 1 and length(block_text) < 40 and not ends_with(block_text, '.') then {HEADING_PAUSE}::double else 1.0::double end"
_STARTS = "select doc_id, block, unit, ms, coalesce(sum(ms) over (partition by doc_id order by block, unit rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms from m"
ORACLE_SQL |= {
    "d15_word_pacing": rf"""with {L._BLOCKS}, {_BLOCK_SPEEDS}, {L._spoken('blocks', 'doc_id, block', 'en')}, w as (select doc_id, block, text as block_text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from blocks),
u as (select doc_id, block, block_text, len(w) as n, unnest(range(len(w))) as unit, unnest(w) as word from w),
m as (select u.doc_id, u.block, unit, floor(greatest(80.0::double, 60000.0::double / speed * (1 + {L._HYPHENS.format('word')}) * ((0.7::double + complexity * 0.6::double) * 0.4::double + {L._SPEED} * 0.6::double) * {L._PAUSE}) * {_LAST_PAUSE} + 0.5::double)::bigint as ms from u join speeds s on s.doc_id = u.doc_id and s.block = u.block join tiered using (word)) {_STARTS}""",
    "d15_sentence_pacing": rf"""with {L._BLOCKS}, {_BLOCK_SPEEDS}, p as (select doc_id, block, text as block_text, regexp_extract_all(text, '[^.!?]*[.!?]+["''»]?\s*|[^.!?]+') as p from blocks), q as (select doc_id, block, block_text, unnest(range(len(p))) as i, unnest(p) as piece from p),
o as (select *, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') as text from q), u as (select *, row_number() over (partition by doc_id, block order by i) - 1 as unit, count(*) over (partition by doc_id, block) as n,
 case when not regexp_matches(piece, '[.!?]') then 1.0 when contains(text, '!') then 2.0 when contains(text, '?') then 1.8 when regexp_matches(text, '\.{{2,}}|…') then 2.5 else 2.0 end::double as pause from o where text <> ''),
m as (select u.doc_id, u.block, unit, floor(greatest(300.0::double, 60000.0::double / speed * (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) + {L._HYPHENS.format('text')}) * pause) * {_LAST_PAUSE} + 0.5::double)::bigint as ms from u join speeds s on s.doc_id = u.doc_id and s.block = u.block) {_STARTS}""",
    "d16_speed_emphasis": f"with {SESSIONS} select event_id, wpm * 2 as wpm, case when wpm * 2 >= 600 then 0.5 when wpm * 2 >= 400 then 0.45 when wpm * 2 >= 200 then 0.4 else 0.35 end::double as proportion from sessions",
}
