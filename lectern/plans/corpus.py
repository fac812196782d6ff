"""Queries of blocks, tokens, pauses and search over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import markdown as M
from lectern.operators import text as D
from lectern.sources import bindings as B


def _docs(s, d):
    return B.table(s, d, "documents")


def _sorted_words(s, d):
    """Distinct words of the corpus: rules of single words run once for each of them."""
    from lectern.functions.common import split_words

    return _docs(s, d).select(F.explode(split_words(F.col("text"))).alias("word")).distinct()


QUERIES = {
    "b01_paragraphs": lambda s, d: D.paragraphs(_docs(s, d), "\n+").select("doc_id", F.col("block").cast("long").alias("block"), "content"),
    "b02_markdown": lambda s, d: _docs(s, d).select("doc_id", D.is_markdown(F.col("text")).alias("markdown")),
    "b03_markdown_blocks": lambda s, d: M.markdown_blocks(_docs(s, d)),
    "b08_pasted_documents": lambda s, d: M.pasted_documents(_docs(s, d)).select("doc_id", "title", "source", "file_hash", F.size("blocks").alias("blocks"), F.array_join(F.transform("blocks", lambda b: F.coalesce(b["content"], F.array_join(b["items"], " "))), " ").alias("text")),
    "b04_plain_inline": lambda s, d: _docs(s, d).select("doc_id", D.without_inline_markdown(F.col("text")).alias("text")),
    "d01_word_tokens": lambda s, d: D.word_tokens(_docs(s, d)),
    "d04_word_count": lambda s, d: _docs(s, d).select("doc_id", D.word_count(F.col("text")).alias("words")),
    "d06_pauses": lambda s, d: _sorted_words(s, d).select("word", D.pause(F.col("word")).alias("pause")),
    "d09_abbreviations": lambda s, d: _sorted_words(s, d).select("word", D.is_abbreviation(F.col("word")).alias("abbreviation"), D.is_title(F.col("word")).alias("title"), D.is_transition(F.col("word")).alias("transition")),
    "d10_recognition_point": lambda s, d: _sorted_words(s, d).select("word", D.recognition_point(F.col("word")).alias("point")),
    "f01_folded_words": lambda s, d: _sorted_words(s, d).select("word", D.folded(F.col("word")).alias("folded")),
    "f03_phrase_search": lambda s, d: D.phrase_matches(_docs(s, d), B.PHRASES),
    "f03_chapter_search": lambda s, d: D.phrase_matches(B.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), "text"), B.PHRASES, "doc_id", "chapter"),
}

_WORDS = "words as (select distinct unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as word from documents)"
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_SHORT = f"(lower(regexp_replace(W, '\\.+$', '')) in ({_LIST(D.ABBREVIATIONS)}) or regexp_matches(lower(regexp_replace(W, '\\.+$', '')), '^[a-zA-Z]$') or regexp_matches(regexp_replace(W, '\\.$', ''), '^[A-Z]{{1,2}}$') or regexp_matches(W, '^[a-zA-Z]\\.([a-zA-Z]\\.)+$'))".replace("{{", "{").replace("}}", "}")
_TRANSITION = f"lower(regexp_replace(W, '[,;:]', '', 'g')) in ({_LIST(D.TRANSITIONS)})"
_MARKS = [p.replace("(?m)", "").replace("[\\s\\S]", "(?:.|\\n)") for p in D.MARKDOWN]


def _markdown() -> str:
    found = [f"regexp_matches(text, '{p}'{', ' + repr('m') if D.MARKDOWN[i].startswith('(?m)') else ''})" for i, p in enumerate(_MARKS)]
    found = [f"regexp_matches(text, '(?m){p}')" if D.MARKDOWN[i].startswith("(?m)") else f"regexp_matches(text, '{p}')" for i, p in enumerate(_MARKS)]
    return f"({' + '.join(f'{f}::int' for f in found)}) >= 2 or {found[0]} or {found[4]}"


_PAUSE = f"""case when regexp_matches(word, '\\.{{2,}}$|…$') then 2.5 when regexp_matches(word, '[.!?]["''»]?$') then case when regexp_matches(word, '\\.["''»]?$') and {_SHORT.replace("W", '''regexp_replace(word, '["''»]+$', '')''')} then 1.0 when regexp_matches(word, '[?]["''»]?$') then 1.8 else 2.0 end
when regexp_matches(word, '[)\\]]$') then 1.2 when regexp_matches(word, '["''»]$') and not regexp_matches(word, '^["''«]') then 1.3 when ends_with(word, ';') then 1.7 when ends_with(word, ':') then 1.6 when ends_with(word, ',') then case when {_TRANSITION.replace("W", "regexp_replace(word, ',$', '')")} then 1.7 else 1.5 end
when regexp_matches(word, '[-–—]$') then 1.3 when {_TRANSITION.replace("W", "word")} then 1.2 else 1.0 end::double"""



def searched(source: str, keys: str) -> str:
    """CTEs: found, the matches of each phrase in each text of ``source``."""
    words = rf"w as (select {keys}, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(strip_accents(lower(x)), '[^\p{{L}}\p{{N}}]', '', 'g')) as w from {source})"
    some = []
    for phrase in B.PHRASES:
        terms = D.search_terms(phrase)
        inside = " and ".join(f"contains(w[i + {k + 1}], '{t}')" for k, t in enumerate(terms))
        some.append(f"select {keys}, '{phrase}' as phrase, {len(terms)} as n, unnest(list_filter(range(greatest(len(w) - {len(terms) - 1}, 0)), lambda i: {inside})) as start_word from w")
    return f"{words}, found as (select {keys}, phrase, start_word, start_word + n - 1 as end_word from ({' union all '.join(some)}))"


ORACLE_SQL = {
    "b01_paragraphs": "select doc_id, unnest(range(len(p))) as block, unnest(p) as content from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') as p from documents)",
    "b02_markdown": f"select doc_id, {_markdown()} as markdown from documents",
    "d01_word_tokens": "with p as (select doc_id, regexp_extract_all(text, '[^\\s]+|\\s+') as p from documents), u as (select doc_id, unnest(range(len(p))) as i, unnest(p) as piece from p), o as (select doc_id, i, piece, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from u) select doc_id, row_number() over (partition by doc_id order by i) - 1 as word, piece as text, start, start + length(piece) as end from o where not regexp_matches(piece, '^\\s')",
    "d04_word_count": "select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words from documents",
    "d06_pauses": f"with {_WORDS} select word, {_PAUSE} as pause from words",
    "d09_abbreviations": f"with {_WORDS} select word, {_SHORT.replace('W', 'word')} as abbreviation, regexp_replace(lower(word), '\\.$', '') in ({_LIST(D.TITLES)}) as title, {_TRANSITION.replace('W', 'word')} as transition from words",
    "d10_recognition_point": f"with {_WORDS}, n as (select word, length(regexp_replace(word, '[^A-Za-z0-9_]', '', 'g')) as n from words) select word, case when n <= 1 then 0 when n <= 5 then 1 else floor(n * 0.3::double)::bigint end as point from n",
    "f01_folded_words": f"with {_WORDS} select word, strip_accents(lower(word)) as folded from words",
    "f03_phrase_search": f"with {searched('documents', 'doc_id')} select doc_id, phrase, start_word, end_word from found",
    "f03_chapter_search": f"with chapters as (select conv_id as doc_id, turn as chapter, text from conversations), {searched('chapters', 'doc_id, chapter')} select doc_id, chapter, phrase, start_word, end_word from found",
}
