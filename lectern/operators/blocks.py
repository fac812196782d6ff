"""Typed blocks (doc_id, block, type, level, content): UI filter, chapters, table of contents, layout lines, emphasis, pacing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import round_half_up, slices, split_words, trimmed
from lectern.operators.language import WordTimes, sentence_duration
from lectern.operators.text import sentence_tokens

#: Texts that are no part of an article, and texts of controls; case does not matter.
NON_ARTICLE = (
    "oppsummeringen er laget med kunstig intelligens", "kvalitetssikret av .+ journalister", "kortversjonen", "les hele saken", "this summary was (generated|created) (by|with|using) (ai|artificial intelligence)", "ai[- ]generated summary",
    "key (takeaways|points|highlights)", "^(summary|tldr|tl;dr)$", "in (this article|brief)", "^vis (mer|mindre)$", "^show (more|less)$", "^read (more|less)$", "^les (mer|mindre)$", "^expand$", "^collapse$", "^utvid$", "^skjul$",
)
CONTROLS = (
    r"^\d{1,2}:\d{2}(:\d{2})?$", r"^\d+%$", r"^\d+\s*(seconds?|minutes?|hours?|sekunder?|minutter?|timer?)$", "^(play|pause|mute|unmute|volume|stop|rewind|forward)$", "^(spill|stopp|lyd|volum)$",
    "^(fullscreen|exit fullscreen|fullskjerm|avslutt fullskjerm)$", "^(advertisement|annonse|ad|reklame|sponsored)$", "^lytt (til saken|igjen)", "^listen (to article|again)", r"keyboard\s*shortcuts?", "hurtigtaster", r"shortcuts?\s*open/close",
    r"^\d+\s+seconds?\s+of\s+\d+", "avspilling har en varighet", r"^volume\s+\d+%$", "^(close|open|show|hide|toggle|lukk|åpne|vis|skjul)$", r"^(subtitles?|captions?|undertekster?)\s*(on|off|på|av)?$", r"^(increase|decrease)\s+(caption|subtitle)\s+size$",
    r"^seek\s+(forward|backward|fremover|bakover)$", r"^søk\s+(fremover|bakover)$", "^vis (mer|mindre)$", "^show (more|less)$", "^read (more|less)$", "^les (mer|mindre)$", "^expand$", "^collapse$", "^utvid$",
)
LEAST_CHARS, LEAST_LETTERS = 15, 0.4
BULLET, NUMBER = r"^[‣◦⁃∙▪▫●○■□–—•-]\s+", r"(?i)^([0-9]+[.):]|\([a-z0-9]+\)|[a-z][.)])\s+"
#: How the tiers of words change the part in bold.
EMPHASIS, EMPHASIS_BY_TIER = 0.4, (0.7, 0.85, 1.0, 1.15, 1.3)
#: Part of a word in bold from a reading speed on.
EMPHASIS_BY_SPEED = ((600, 0.5), (400, 0.45), (200, 0.4))


def typed_blocks(docs: DataFrame) -> DataFrame:
    """Lines of texts as blocks: lines under 40 characters without a final period are headings, of level 1 to 3 by their length."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n+"), trimmed), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("block", "content"))
    heading = (F.length("content") < 40) & ~F.col("content").endswith(".")
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), F.when(heading, "heading").otherwise("paragraph").alias("type"), F.when(heading, F.length("content") % 3 + 1).cast("long").alias("level"), "content")


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Patterns of a text's start stand behind one anchor, so that they are tried once and not at each character."""
    start, inside = [p[1:] for p in patterns if p.startswith("^")], [p for p in patterns if not p.startswith("^")]
    return text.rlike(f"(?iu)^(?:{'|'.join(start)})") | text.rlike("(?iu)" + "|".join(inside))


def is_control(text: Column, strict: bool = True) -> Column:
    """Text of a control, a lone word or symbols; if strict, also a short text and one with few letters."""
    return _is_control(trimmed(text), strict)


def _is_control(t: Column, strict: bool) -> Column:
    found = _matches(t, CONTROLS) | t.rlike("(?i)^[a-z↑↓←→]+$") | t.rlike(r"^[+\-=/\\?!]+$")
    letters = F.length(F.regexp_replace(t, "[^a-zA-ZæøåÆØÅ]", ""))
    return found | (F.length(t) < LEAST_CHARS) | (letters < F.length(t) * LEAST_LETTERS) if strict else found


def article_blocks(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks without controls and summaries by machines; headings may be short."""
    # exploded, as the plan would else trim the text anew for each rule
    t = F.col("trimmed_content")
    gone = F.when(F.col("type") == "heading", _matches(t, CONTROLS)).otherwise(_is_control(t, strict))
    return blocks.withColumn("trimmed_content", F.explode(F.array(trimmed(F.col("content"))))).where(~_matches(t, NON_ARTICLE) & ~gone).select(*blocks.columns)


def plain_texts(blocks: DataFrame) -> DataFrame:
    """The text of each document, its blocks joined by spaces, and how many there are."""
    rows = F.array_sort(F.collect_list(F.struct("block", "content")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["content"]), " ").alias("text"), F.count("*").alias("blocks"))


def first_headings(blocks: DataFrame) -> DataFrame:
    """The first heading of each document that has one."""
    return blocks.where("type = 'heading'").groupBy("doc_id").agg(F.min_by("content", "block").alias("heading"))


def heading_chapters(blocks: DataFrame) -> DataFrame:
    """Chapters from headings of level 1 and 2; those of at most 100 characters go, but for the last.  Blocks before the first
    heading are ``Beginning``, and so is a document's first chapter."""
    order = Window.partitionBy("doc_id").orderBy("block")
    start = (F.coalesce(F.col("level") <= 2, F.lit(False)) & (F.row_number().over(order) > 1)).cast("int")
    rows = blocks.select("doc_id", "block", "content", start.alias("start")).withColumn("part", F.sum("start").over(order))
    size = F.sum(F.length("content")) + F.count("*") - 1
    parts = rows.groupBy("doc_id", "part").agg(F.min_by("content", "block").alias("first"), size.alias("chars"), F.sum(F.size(split_words(F.col("content")))).alias("words"))
    last = Window.partitionBy("doc_id")
    kept = parts.withColumn("last", F.max("part").over(last)).where((F.col("chars") > 100) | (F.col("part") == F.col("last")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return kept.select("doc_id", place.cast("long").alias("chapter"), F.when(F.col("part") == 0, "Beginning").otherwise(F.col("first")).alias("title"), "chars", "words")


def merged_sections(sections: DataFrame, least: int = 50) -> DataFrame:
    """Sections (book, section, words) of under ``least`` words join the chapter before them; the first always opens one."""
    order = Window.partitionBy("book").orderBy("section")
    opens = ((F.col("words") >= least) | (F.row_number().over(order) == 1)).cast("int")
    rows = sections.select("book", "section", "words", opens.alias("opens")).withColumn("chapter", F.sum("opens").over(order) - 1)
    return rows.groupBy("book", "chapter").agg(F.min("section").alias("first_section"), F.count("*").alias("sections"), F.sum("words").alias("words"))


def kept_chapters(chapters: DataFrame, least: int = 20) -> DataFrame:
    """Chapters (book, chapter, words, label) of ``least`` words and the first one, numbered anew; without a label they are
    ``Chapter n``."""
    order = Window.partitionBy("book").orderBy("chapter")
    kept = chapters.withColumn("first", F.row_number().over(order) == 1).where(F.col("first") | (F.col("words") >= least))
    number = F.row_number().over(order).cast("long")
    return kept.select("book", number.alias("number"), "chapter", "words", F.coalesce("label", F.concat(F.lit("Chapter "), number.cast("string"))).alias("title"))


def flat_toc(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """The given table of contents (book, number, title), or the chapters where it is empty or covers under half of them."""
    given, own = toc.groupBy("book").agg(F.count("*").alias("given")), chapters.groupBy("book").agg(F.count("*").alias("own"))
    poor = own.join(given, "book", "left").where(F.coalesce("given", F.lit(0)) * 2 < F.col("own")).select("book")
    return toc.select("book", "number", "title").join(poor, "book", "left_anti").unionByName(chapters.select("book", "number", "title").join(poor, "book", "left_semi"))


def layout_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from layout lines (doc_id, line, text, font_size, bold; empty text ends a paragraph).  The body size is the most
    frequent one in steps of a half, the first met on ties; larger or bold short lines are headings."""
    filled = lines.where("text <> ''")
    sizes = filled.groupBy("doc_id", (F.floor(F.col("font_size") * 2 + 0.5) / 2.0).alias("size")).agg(F.count("*").alias("n"), F.min("line").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    ratio, bold, t = F.col("font_size") / F.col("body"), F.col("bold"), F.col("text")
    kind = F.when(t == "", "gap").when(t.rlike(BULLET), "bullets").when(t.rlike(NUMBER), "numbers").when(((ratio >= 1.15) | bold) & (F.length(t) < 100), "heading").otherwise("paragraph")
    level = F.when((ratio >= 1.8) | ((ratio >= 1.5) & bold), 1).when(ratio >= 1.4, 2).when((ratio >= 1.2) | bold, 3).otherwise(4)
    rows = lines.join(body, "doc_id").select("doc_id", "line", kind.alias("kind"), level.alias("level"), F.when(kind == "bullets", F.regexp_replace(t, BULLET, "")).when(kind == "numbers", F.regexp_replace(t, NUMBER, "")).otherwise(t).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    opens = F.when((F.col("kind") == "heading") | F.lag("kind").over(order).isNull() | (F.col("kind") != F.lag("kind").over(order)), 1).otherwise(0)
    runs = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order)).where("kind <> 'gap'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"])
    found = runs.groupBy("doc_id", "run", "kind").agg(F.min("level").alias("level"), F.array_join(parts, " ").alias("content"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return found.select("doc_id", number.cast("long").alias("block"), F.col("kind").alias("type"), F.when(F.col("kind") == "heading", F.col("level")).cast("long").alias("level"), trimmed(F.col("content")).alias("content"))


def bold_length(word: Column, proportion: Column) -> Column:
    """Characters of a word in bold: the proportion rounded, down in words of up to three, one at least."""
    n = F.length(word)
    part = F.when(n <= 3, F.floor(n * proportion)).otherwise(F.floor(n * proportion + 0.5))
    return F.least(n, F.greatest(F.lit(1), part)).cast("int")


def adaptive_proportion(tier: Column, base: float = EMPHASIS) -> Column:
    """Proportion for a tier, from 0.2 to 0.6."""
    return F.greatest(F.lit(0.2), F.least(F.lit(0.6), F.element_at(F.array(*map(F.lit, EMPHASIS_BY_TIER)), tier.cast("int")) * base))


def pacing(readability: DataFrame, wpm: int) -> DataFrame:
    """Speed, time (ms, 500 at least) and start of each block from its readability (words, wpm_factor)."""
    speed = round_half_up(F.col("wpm_factor") * wpm)
    timed = readability.select("doc_id", "block", speed.alias("speed"), F.greatest(F.lit(500).cast("long"), round_half_up(F.col("words") / speed * 60000.0)).alias("ms"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return timed.select("*", F.coalesce(F.sum("ms").over(before), F.lit(0)).alias("start_ms"))


def paced_words(blocks: DataFrame, readability: DataFrame, wpm: int, heading_pause: float = 1.0, adaptive: bool = True) -> DataFrame:
    """Time (whole ms) and start of each word of typed blocks (doc_id, block, type, content), at its block's speed; the last word of a
    heading waits ``heading_pause`` times as long.  Blocks meet their speeds before they are cut, and go to their document's task in order,
    where times add up: no word is shuffled or sorted.  Words follow the English rules, whatever their language."""
    rows = _at_speed(blocks, readability, wpm).select("doc_id", "block", (F.col("type") == "heading").alias("heading"), "speed", "content")
    wait = max(1.0, heading_pause)

    def pace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, doc, start = WordTimes(adaptive), None, 0
        for batch in batches:
            for part in slices(batch):
                ids, found = part.column(0).to_pylist(), []
                begins: list[np.ndarray] = []
                for own, heading, speed, text in zip(ids, *(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    ms = times.of(text or "", speed)
                    if heading and len(ms):
                        ms[-1] *= wait
                    found.append(np.floor(ms + 0.5).astype(np.int64))
                    if own != doc:
                        doc, start = own, 0
                    upto = np.cumsum(found[-1]) + start
                    begins.append(upto - found[-1])
                    start = int(upto[-1]) if len(upto) else start
                size = np.array([len(x) for x in found], np.int64)
                place = pa.array(np.repeat(np.arange(len(size)), size))
                unit = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), part.column(1).take(place), *(pa.array(x) for x in (unit, np.concatenate(found), np.concatenate(begins)))], names)

    names = ["doc_id", "block", "unit", "ms", "start_ms"]
    kinds = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "block")]
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "block")
    return ordered.mapInArrow(pace, f"doc_id {kinds[0]}, block {kinds[1]}, unit long, ms long, start_ms long")


def paced_sentences(blocks: DataFrame, readability: DataFrame, wpm: int, heading_pause: float = 1.0) -> DataFrame:
    """The same for the sentences of blocks, 300 ms at least."""
    texts = blocks.select(F.struct("doc_id", "block").alias("doc_id"), F.col("content").alias("text"))
    cut = sentence_tokens(texts).select("doc_id.*", "sentence", "text", "pause")
    last = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy(F.desc("sentence"))) == 1
    number = (F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("sentence")) - 1).alias("unit")
    speeds = _at_speed(blocks, readability, wpm).select("doc_id", "block", "type", "speed")
    rows = cut.select("doc_id", "block", "text", "pause", number, last.alias("last")).join(speeds, ["doc_id", "block"])
    timed = rows.withColumns({"n": F.when(F.col("last"), F.col("unit") + 1).otherwise(-1), "ms": sentence_duration(F.col("speed"))})
    return _started(timed, heading_pause)


def _at_speed(blocks: DataFrame, readability: DataFrame, wpm: int) -> DataFrame:
    speeds = readability.select("doc_id", "block", round_half_up(F.col("wpm_factor") * wpm).alias("speed"))
    return blocks.join(speeds, ["doc_id", "block"])


def _started(timed: DataFrame, heading_pause: float) -> DataFrame:
    """Units (doc_id, block, unit of n, type, ms) with the pause after headings, and their starts."""
    ends = (F.col("type") == "heading") & (F.col("unit") == F.col("n") - 1)
    ms = round_half_up(F.when(ends, F.col("ms") * max(1.0, heading_pause)).otherwise(F.col("ms")))
    before = Window.partitionBy("doc_id").orderBy("block", "unit").rowsBetween(Window.unboundedPreceding, -1)
    rows = timed.select("doc_id", "block", F.col("unit").cast("long").alias("unit"), ms.alias("ms"))
    return rows.select("*", F.coalesce(F.sum("ms").over(before), F.lit(0)).alias("start_ms"))


def proportion_at(wpm: Column) -> Column:
    """Part of a word in bold by reading speed."""
    part = F.when(wpm >= EMPHASIS_BY_SPEED[0][0], EMPHASIS_BY_SPEED[0][1])
    for least, value in EMPHASIS_BY_SPEED[1:]:
        part = part.when(wpm >= least, value)
    return part.otherwise(0.35)


def time_label(minutes: Column) -> Column:
    """Seconds under a minute, minutes under an hour, else hours and minutes."""
    whole = lambda c: round_half_up(c).cast("string")
    rest = round_half_up(minutes % 60)
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))
    return F.when(minutes < 1, F.concat(whole(minutes * 60), F.lit("s"))).when(minutes < 60, F.concat(whole(minutes), F.lit("m"))).when(rest > 0, F.concat(hours, F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(hours)


def time_remaining(offsets: DataFrame, wpm: int) -> DataFrame:
    """Time left at each block (doc_id, block, words, start), and that of the whole document."""
    total = F.sum("words").over(Window.partitionBy("doc_id"))
    left = offsets.select("doc_id", "block", (total - F.col("start")).alias("left"), total.alias("total"))
    return left.select("doc_id", "block", time_label(F.col("left") / F.lit(float(wpm))).alias("remaining"), time_label(F.col("total") / F.lit(float(wpm))).alias("total"))


def matches_at(words: DataFrame | None, matches: DataFrame, *keys: str) -> DataFrame:
    """the first match (doc_id, start_word, end_word) over each word (doc_id, word), its number, and whether it starts there; with
    keys (as phrase) beside doc_id, for each of them.  Without words, over each word that a match covers.  A match is the first over
    those of its words that no match before it reaches, so only matches are shuffled, and words are neither grouped nor sorted."""
    own = ["doc_id", *keys]
    order = Window.partitionBy(*own).orderBy("start_word", "end_word")
    number = F.row_number().over(order).cast("long") - 1
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("start_word"), F.coalesce(reached + 1, F.col("start_word")))
    numbered = matches.select(*own, "start_word", "end_word", number.alias("match"), fresh.alias("fresh")).where("fresh <= end_word")
    spread = numbered.select(*own, "match", "start_word", F.explode(F.sequence("fresh", "end_word")).alias("word"))
    found = spread.select(*own, "word", "match", (F.col("word") == F.col("start_word")).alias("starts"))
    return found if words is None else words.join(found, ["doc_id", "word"]).select(*own, "word", "match", "starts")


def neighbour_matches(matches: DataFrame, *keys: str) -> DataFrame:
    """where the next and the previous match of each match start, round the ends."""
    order = Window.partitionBy("doc_id", *keys).orderBy("start_word")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return matches.select("doc_id", *keys, "start_word", F.coalesce(F.lead("start_word").over(order), F.first("start_word").over(whole)).alias("next_start"), F.coalesce(F.lag("start_word").over(order), F.last("start_word").over(whole)).alias("previous_start"))
