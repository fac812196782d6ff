"""Queries of language, readability, sentences, chunks, reading times and positions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import language as E
from lectern.operators import text as D
from lectern.plans.corpus import _PAUSE, _SHORT
from lectern.sources import bindings as B

WPM, CHUNK = 250, 3


def _docs(s, d):
    return B.table(s, d, "documents")


def _vocabulary(s, d):
    """Distinct words of each language: rules of single words run once for each of them."""
    return E.spelled(E.distinct_words(_docs(s, d)))


def _offsets(s, d):
    return D.block_offsets(D.paragraphs(_docs(s, d), "\n+"))


def _paragraph_texts(s, d):
    return D.paragraphs(_docs(s, d), "\n+").select("doc_id", F.col("block").cast("long").alias("block"), F.col("content").alias("text"))


def _dictionary(s, d):
    """Counts for the words of the benchmark, as a library might load them."""
    words = B.table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    return words.select(F.lit("en").alias("language"), "word", (F.length("word") % 6 + 1).alias("syllables"))


QUERIES = {
    "e03_dictionary_syllables": lambda s, d: E.with_dictionary(_vocabulary(s, d), _dictionary(s, d)).select("word", "language", "syllables"),
    "d02_sentence_tokens": lambda s, d: D.sentence_tokens(_docs(s, d)),
    "d03_chunks": lambda s, d: D.chunks(_docs(s, d), CHUNK, "\n+"),
    "d05_timing_words": lambda s, d: _docs(s, d).select("doc_id", E.timing_words(F.col("text")).alias("words")),
    "d11_complexity": lambda s, d: _vocabulary(s, d).select("word", "language", E.complexity().alias("complexity")),
    "d12_word_tiers": lambda s, d: _vocabulary(s, d).select("word", "language", E.tier().alias("tier")).select("*", E.speed(F.col("tier")).alias("speed"), (F.col("tier") <= 2).alias("common"), ((F.col("tier") - 1) / F.lit(4.0)).alias("difficulty")),
    "d12_tier_counts": lambda s, d: E.tier_counts(_docs(s, d)),
    "d13_word_durations": lambda s, d: _vocabulary(s, d).select("word", "language", E.word_duration(WPM).alias("ms")),
    "d13_sentence_durations": lambda s, d: D.sentence_tokens(_docs(s, d)).select("doc_id", "sentence", E.sentence_duration(F.lit(float(WPM))).alias("ms")),
    "d13_token_durations": lambda s, d: D.chunks(_docs(s, d), CHUNK, "\n+").select("doc_id", "paragraph", "chunk", E.token_duration(F.lit(float(WPM))).alias("ms")),
    "e08_reports": lambda s, d: E.report(E.readability(_docs(s, d))),
    "d14_reading_minutes": lambda s, d: _docs(s, d).select("doc_id", (D.word_count(F.col("text")) / F.lit(float(WPM))).alias("minutes")),
    "d17_block_offsets": _offsets,
    "d18_positions": lambda s, d: D.positions_at(_docs(s, d).select("doc_id", (F.col("doc_id") * 7919 % (D.word_count(F.col("text")) + 2)).alias("target")), _offsets(s, d)),
    "d19_chunk_index": lambda s, d: _offsets(s, d).select("doc_id", "block", F.floor(F.col("start") / CHUNK).cast("long").alias("chunk"), (F.floor(F.col("start") / CHUNK) * CHUNK).cast("long").alias("chunk_start")),
    "e01_sentences": lambda s, d: E.sentences(_docs(s, d)),
    "e01_sentence_counts": lambda s, d: _docs(s, d).select("doc_id", E.sentence_count(F.col("text")).alias("sentences")),
    "e02_syllables": lambda s, d: _vocabulary(s, d).select("word", "language", "syllables"),
    "e04_language": lambda s, d: _docs(s, d).select("doc_id", E.language_of(F.col("text")).alias("language")),
    "e06_complex_words": lambda s, d: _vocabulary(s, d).select("word", "language", E.is_complex().alias("complex")),
    "e07_readability": lambda s, d: E.readability(_docs(s, d)),
    "e08_reading_levels": lambda s, d: E.described(E.readability(_docs(s, d)), WPM).select("doc_id", "description", "adjusted_wpm"),
    "e10_block_readability": lambda s, d: E.readability(_paragraph_texts(s, d), "doc_id", "block"),
}


def _one_of(column: str, words) -> str:
    return f"{column} in ({', '.join(repr(w) for w in words)})"


def _score(words) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(w) for w in words)}], x)))"


def _letters(column: str) -> str:
    return f"lower(regexp_replace({column}, '[^a-zA-ZæøåÆØÅ]', '', 'g'))"


def _syllables(w: str) -> str:
    """Syllables of the letters ``w`` of a word in the language ``language``."""
    latin = f"regexp_replace({w}, '[^a-z]', '', 'g')"
    known = " ".join(f"when language = '{code}' and {_one_of(w, words)} then {n}" for code, table in (("en", E.ENGLISH), ("no", E.NORWEGIAN)) for n, words in E.by_count(table).items())
    english = f"case when length({latin}) <= 2 then 1 else greatest(1, greatest(1, len(regexp_extract_all({latin}, '[aeiouy]+'))) - regexp_matches({latin}, '{E.SILENT}')::int) end"
    return f"(case when length({w}) = 0 then 0 when length({w}) <= 2 then 1 {known} when language = 'no' then greatest(1, len(regexp_extract_all({w}, '[aeiouyæøå]+'))) else {english} end)::bigint"


def _sentences(text: str) -> str:
    """E1 as a fold over the marks of a text."""
    mark = r"""([^.!?]*)([.!?]+["''»]?\s*)"""
    text = f"coalesce({text}, '')"
    body, rest = f"regexp_extract_all({text}, '{mark}', 1)", f"regexp_replace({text}, '{mark}', '', 'g')"
    word = r"regexp_extract(regexp_replace(a.carry || x.body, '\s+$', ''), '(\S+)$', 1)"
    goes_on = rf"(regexp_matches({word}, '^[A-Z]\.?$') or {_one_of(rf"regexp_replace(lower({word}), '\.$', '')", D.TITLES)} or regexp_matches(x.following, '^\s*[a-z]'))"
    on = f"({word} <> '' and {_SHORT.replace('W', f"({word} || '.')")} and {goes_on})"
    start = "{'body': '', 'mark': '', 'following': '', 'carry': '', 'n': 0::bigint}"
    step = f"{{'body': '', 'mark': '', 'following': '', 'carry': case when {on} then regexp_extract(a.carry || x.body || x.mark, '(\\S+\\s*)$', 1) else '' end, 'n': a.n + (not {on})::bigint}}"
    pieces = f"list_transform(range(len({body})), lambda i: {{'body': {body}[i + 1], 'mark': regexp_extract_all({text}, '{mark}', 2)[i + 1], 'following': coalesce({body}[i + 2], {rest}), 'carry': '', 'n': 0::bigint}})"
    return f"list_transform([list_reduce({pieces}, lambda a, x: {step}, {start})], lambda s: s.n + regexp_matches(s.carry || {rest}, '\\S')::bigint)[1]"


def _spoken(source: str, keys: str, language: str = "") -> str:
    """CTEs: the language of each text of ``source`` (or the one given), its words and what the rules say of them."""
    read = f"'{language}' as language" if language else "language"
    stem = "regexp_replace(regexp_replace(regexp_replace(w, 'ed$', ''), 'es$', ''), 'ing$', '')"
    return f"""lower_words as (select *, list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: {_letters("x")}) as w from {source}),
lang as (select {keys}, text, case when coalesce(len(regexp_extract_all(lower(text), '[æøå]'))::double / nullif(length(text), 0), 0) > 0.001::double or ({_score(E.NORWEGIAN_WORDS)} > 1.5::double * {_score(E.ENGLISH_WORDS)} and {_score(E.NORWEGIAN_WORDS)} > 3) then 'no' else 'en' end as language,
 {_sentences("text")} as sentences from lower_words),
tokens as (select {keys}, {read}, sentences, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as word from lang),
vocabulary as (select word, language, w, {stem} as stem, {_syllables("w")} as syllables from (select distinct word, language, {_letters("word")} as w from tokens)),
judged as (select word, language, w, syllables, length(w) >= 3 and syllables >= 3 and {_syllables("stem")} >= 3 as complex, case when length(w) <= 2 then 0 when length(w) <= 3 then 0.1::double else least(1.0::double, (length(w) - 3) / 9.0::double) * 0.4::double + least(1.0::double, (syllables - 1) / 3.0::double) * 0.6::double end as complexity,
 length(regexp_replace(lower(word), '[^{E.TIER_LETTERS}]', '', 'g')) as n from vocabulary),
tiered as (select *, case when n = 0 then 3 else floor(((case when n <= 2 then 1 when n <= 4 then 2 when n <= 7 then 3 when n <= 10 then 4 else 5 end) * 7 + least(greatest(syllables, 1), 5) * 3 + 5) / 10.0::double)::bigint end as tier from judged)"""


def _scores(source: str, keys: str) -> str:
    both = " and ".join(f"l.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    tenth = lambda c, d, u=10: f"case when read then floor({c} * {u}.0::double + 0.5::double) / {u}.0::double else {d}::double end"
    return f"""{_spoken(source, keys)},
sums as (select {own}, l.language, l.sentences, count(t.word) as words, coalesce(sum(v.syllables), 0)::bigint as syllables, count(*) filter (v.complex) as complex_words from lang l left join tokens t on {both} left join judged v on v.word = t.word and v.language = t.language group by {own}, l.language, l.sentences),
rates as (select *, words > 0 and sentences > 0 as read, coalesce(words::double / nullif(sentences, 0), 0) as a, coalesce(syllables::double / nullif(words, 0), 0) as b, coalesce(complex_words::double / nullif(words, 0), 0) * 100.0::double as share from sums),
indices as (select *, greatest(0.0::double, least(100.0::double, 206.835::double - 1.015::double * a - 84.6::double * b)) as ease, greatest(0.0::double, 0.39::double * a + 11.8::double * b - 15.59::double) as grade, 0.4::double * (a + share) as fog from rates),
smogs as (select *, case when sentences >= 3 then 1.043::double * sqrt(complex_words * (30.0::double / sentences)) + 3.1291::double else grade end as smog from indices),
composed as (select *, grade * 0.4::double + fog * 0.3::double + smog * 0.3::double as composite from smogs),
scores as (select {keys}, language, words, sentences, syllables, complex_words, {tenth("ease", 100)} as flesch_ease, {tenth("grade", 0)} as flesch_grade, {tenth("fog", 0)} as fog_index, {tenth("smog", 0)} as smog_index, {tenth("a", 0)} as words_per_sentence, {tenth("b", 0, 100)} as syllables_per_word, {tenth("share", 0)} as complex_percent,
 case when not read or composite <= 6 then 'easy' when composite <= 10 then 'medium' when composite <= 14 then 'hard' else 'very-hard' end as level, (case when not read then 1.0 when composite <= 6 then 1.15 when composite <= 10 then 1.0 when composite <= 14 then 0.9 else 0.8 end)::double as wpm_factor from composed)"""


_BLOCKS = r"blocks as (select doc_id, unnest(range(len(p))) as block, unnest(p) as text from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') as p from documents))"
_OFFSETS = rf"{_BLOCKS}, counted as (select doc_id, block, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as words from blocks), offsets as (select *, coalesce(sum(words) over (partition by doc_id order by block rows between unbounded preceding and 1 preceding), 0)::bigint as start from counted)"
_HYPHENS = "len(regexp_extract_all(regexp_replace({}, '([a-zA-ZæøåÆØÅ])-', '\\1' || chr(1), 'g'), '\\x01[a-zA-ZæøåÆØÅ]'))"
_SPEED = "([" + ", ".join(f"{v}::double" for v in E.SPEED) + "])[tier]"
_WORDS = _spoken("documents", "doc_id")
_BANDS = " ".join(f"when flesch_ease >= {n} then '{label}'" for n, label in E.BANDS)

ORACLE_SQL = {
    "d02_sentence_tokens": r"""with p as (select doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+["''»]?\s*|[^.!?]+') as p from documents), u as (select doc_id, unnest(range(len(p))) as i, unnest(p) as piece from p),
o as (select doc_id, i, piece, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') as text from u)
select doc_id, i as sentence, text, start, start + length(piece) as end, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as words, (case when not regexp_matches(piece, '[.!?]') then 1.0 when contains(text, '!') then 2.0 when contains(text, '?') then 1.8 when regexp_matches(text, '\.{2,}|…') then 2.5 else 2.0 end)::double as pause from o where text <> ''""",
    "d03_chunks": rf"""with r as (select doc_id, regexp_split_to_array(text, '\n+') as r from documents), p as (select doc_id, len(r) as n, unnest(range(len(r))) as paragraph, unnest(r) as part from r), w as (select doc_id, n, paragraph, list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> '') as w from p), c as (select *, unnest(range(0, len(w), {CHUNK})) as place from w),
e as (select doc_id, paragraph, place // {CHUNK} as chunk, array_to_string(w[place + 1 : place + {CHUNK}], ' ') as text, w[least(place + {CHUNK}, len(w))] as word, place + {CHUNK} >= len(w) and paragraph < n - 1 as paragraph_end from c) select doc_id, paragraph, chunk, text, case when paragraph_end then greatest({_PAUSE}, 3.0::double) else {_PAUSE} end as pause, paragraph_end from e""",
    "d05_timing_words": rf"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) + {_HYPHENS.format('text')} as words from documents",
    "d11_complexity": f"with {_WORDS} select word, language, complexity from judged",
    "d12_word_tiers": f"with {_WORDS} select word, language, tier, {_SPEED} as speed, tier <= 2 as common, (tier - 1) / 4.0::double as difficulty from tiered",
    "d12_tier_counts": f"with {_WORDS} select doc_id, {', '.join(f'count(*) filter (tier = {t}) as tier_{t}' for t in range(1, 6))} from tokens t join tiered v on t.word = v.word and t.language = v.language group by doc_id",
    "d13_word_durations": f"with {_WORDS} select word, language, greatest(80.0::double, {60000 / WPM}::double * (1 + {_HYPHENS.format('word')}) * ((0.7::double + complexity * 0.6::double) * 0.4::double + {_SPEED} * 0.6::double) * {_PAUSE}) as ms from tiered",
    "d14_reading_minutes": rf"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / {WPM}.0::double as minutes from documents",
    "d17_block_offsets": f"with {_OFFSETS} select * from offsets",
    "d18_positions": rf"""with {_OFFSETS}, t as (select doc_id, doc_id * 7919 % (len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) + 2) as target from documents), total as (select doc_id, sum(words) as total, max(block) as last, arg_max(words, block) as last_words from offsets group by doc_id)
select t.doc_id, target, coalesce(case when target >= total then last else o.block end, 0) as block, coalesce(case when target >= total then greatest(last_words - 1, 0) else target - o.start end, 0)::bigint as word from t left join total x on x.doc_id = t.doc_id left join offsets o on o.doc_id = t.doc_id and target >= o.start and target < o.start + o.words""",
    "d19_chunk_index": f"with {_OFFSETS} select doc_id, block, start // {CHUNK} as chunk, start // {CHUNK} * {CHUNK} as chunk_start from offsets",
    "e03_dictionary_syllables": f"""with {_WORDS}, b as (select distinct unnest(string_split(text, ' ')) as word from benchmark), e as (select lower(word) as letters, max(length(word) % 6 + 1)::bigint as entry from b where word <> '' group by 1),
x as (select word, language, {_letters("word")} as letters, syllables from vocabulary) select word, language, case when language = 'en' and length(letters) > 2 and not {_one_of("letters", [w for own in E.by_count(E.ENGLISH).values() for w in own])} then coalesce(entry, syllables) else syllables end as syllables from x left join e using (letters)""",
    "e02_syllables": f"with {_WORDS} select word, language, syllables from vocabulary",
    "e04_language": f"with {_WORDS} select doc_id, language from lang",
    "e06_complex_words": f"with {_WORDS} select word, language, complex from judged",
    "e01_sentence_counts": f"select doc_id, {_sentences('text')} as sentences from documents",
    "e07_readability": f"with {_scores('documents', 'doc_id')} select * from scores",
    "e08_reading_levels": f"with {_scores('documents', 'doc_id')} select doc_id, case {_BANDS} else 'Very difficult (Grade ' || floor(flesch_grade + 0.5::double)::bigint || '+)' end as description, floor({WPM} * wpm_factor + 0.5::double)::bigint as adjusted_wpm from scores",
    "e10_block_readability": f"with {_BLOCKS}, {_scores('blocks', 'doc_id, block')} select * from scores",
}
ORACLE_SQL |= {
    "d13_sentence_durations": f"with x as ({ORACLE_SQL['d02_sentence_tokens']}) select doc_id, sentence, greatest(300.0::double, {60000 / WPM}::double * (words + {_HYPHENS.format('text')}) * pause) as ms from x",
    "d13_token_durations": f"with x as ({ORACLE_SQL['d03_chunks']}) select doc_id, paragraph, chunk, {60000 / WPM}::double * (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + {_HYPHENS.format('text')}) * pause as ms from x",
    "e08_reports": f"""with {_scores('documents', 'doc_id')} select doc_id, case {_BANDS} else 'Very difficult (Grade ' || floor(flesch_grade + 0.5::double)::bigint || '+)' end as summary, flesch_ease, flesch_grade, fog_index, smog_index, language,
 case when wpm_factor < 1 then 'Consider reading ' || floor((1 - wpm_factor) * 100 + 0.5)::bigint || '% slower for better comprehension' when wpm_factor > 1 then 'This text is easy - you can read ' || floor((wpm_factor - 1) * 100 + 0.5)::bigint || '% faster' else 'Normal reading speed recommended' end as recommendation from scores""",
}
