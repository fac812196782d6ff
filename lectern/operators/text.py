"""Text to blocks, tokens, pauses and searches. Expressions stay in the JVM, but for places along a text, which are read off it in
Arrow batches without a shuffle; tokens carry only the columns they need."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.common import WHITE, slices, split_words, trimmed

#: Transition words, abbreviations, titles and pause multipliers.
TRANSITIONS = ("however nevertheless nonetheless although though whereas conversely instead rather yet still furthermore moreover additionally besides also likewise therefore thus hence consequently accordingly because "
    "specifically namely notably particularly firstly secondly thirdly finally lastly meanwhile subsequently ultimately overall essentially basically").split()  # fmt: skip
ABBREVIATIONS = ("mr mrs ms dr prof sr jr rev hon gov pres gen col lt sgt ph phd md dds esq llb ma ba bs mba rn cpa vs etc eg ie al approx dept est inc corp ltd co jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "st ave blvd rd ln ct apt ste fl mt ft no vol pp pg ch sec fig ref ed oz lb lbs in cm mm km mi kg mg ml hr min u uk usa eu").split()  # fmt: skip
_WORD, _SENTENCE = re.compile(r"\S+", re.ASCII), re.compile(r"""[^.!?]*[.!?]+["'»]?\s*|[^.!?]+""", re.ASCII)
TITLES = "mr mrs ms dr prof sr jr rev hon gov pres gen col lt sgt st".split()
ELLIPSIS, END, QUESTION, EXCLAMATION, PAREN, QUOTE, SEMICOLON, COLON, COMMA, DASH, TRANSITION = 2.5, 2.0, 1.8, 2.0, 1.2, 1.3, 1.7, 1.6, 1.5, 1.3, 1.2
#: Patterns of Markdown, the first and the fifth of which are enough alone.
MARKDOWN = (r"(?m)^#{1,6}\s+.+$", r"(?m)^\s*[-*+]\s+.+$", r"(?m)^\s*\d+\.\s+.+$", r"\[.+?\]\(.+?\)", r"```[\s\S]*?```", r"`[^`]+`", r"(?m)^\s*>\s+.+$", r"\*\*[^*]+\*\*", r"\*[^*]+\*", r"__[^_]+__", r"_[^_]+_", r"(?m)^\s*[-*_]{3,}\s*$")
INLINE = (r"\*\*(.+?)\*\*", r"__(.+?)__", r"\*(.+?)\*", r"_(.+?)_", r"~~(.+?)~~", r"`(.+?)`", r"\[(.+?)\]\(.+?\)", r"!\[(.+?)\]\(.+?\)")


def bare(text: str) -> str:
    """A text without the marks that Unicode's decomposition parts from its letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")


#: Words of which a task keeps what is known, at some 200 bytes each: a few times ten MB in each of an executor's Python workers.
KNOWN_WORDS = 1 << 16
#: Lower-case Latin letters with accents, and what is left of them without.
_ACCENTED = "".join(c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower() and len(bare(c)) == 1 and bare(c) != c)
_BARE = "".join(map(bare, _ACCENTED))


def paragraphs(docs: DataFrame, separator: str = "\n\n+") -> DataFrame:
    """B1: trimmed paragraphs, empty ones dropped, numbered anew."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator), trimmed), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("block", "content"))


def is_markdown(text: Column) -> Column:
    """B2: two patterns, or a heading, or a fence."""
    found = [text.rlike(p) for p in MARKDOWN]
    count = found[0].cast("int")
    for f in found[1:]:
        count = count + f.cast("int")
    return (count >= 2) | found[0] | found[4]


def without_inline_markdown(text: Column) -> Column:
    """Text of inline marks."""
    for p in INLINE:
        text = F.regexp_replace(text, p, "$1")
    return trimmed(text)


def _spans(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]], number: str) -> DataFrame:
    """(doc_id, number, text, start, end) of the pieces of each text. Places add up along a text, so each is read once where it lies: no
    piece is shuffled to be summed up."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [spans(t) for t in texts]
                place = [i for i, own in enumerate(found) for _ in own]
                start, end = ([x[k] for own in found for x in own] for k in (0, 1))
                pieces = [t[a:b] for t, own in zip(texts, found, strict=True) for a, b in own]
                numbers = [k for own in found for k in range(len(own))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), pa.array(numbers, pa.int64()), pa.array(pieces, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", number, "text", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {number} long, text string, start long, end long")


def word_tokens(docs: DataFrame) -> DataFrame:
    """Words with their place and offsets (code points)."""
    return _spans(docs, lambda t: [m.span() for m in _WORD.finditer(t)], "word")


def word_count(text: Column) -> Column:
    """Words of a text."""
    return F.size(split_words(text)).cast("long")


def is_abbreviation(word: Column) -> Column:
    """A known abbreviation, a letter, one or two capitals, or letters with periods."""
    bare = F.lower(F.regexp_replace(word, r"\.+$", ""))
    return bare.isin(*ABBREVIATIONS) | bare.rlike("^[a-zA-Z]$") | F.regexp_replace(word, r"\.$", "").rlike("^[A-Z]{1,2}$") | word.rlike(r"^[a-zA-Z]\.([a-zA-Z]\.)+$")


def is_title(word: Column) -> Column:
    """A title before a name."""
    return F.regexp_replace(F.lower(word), r"\.$", "").isin(*TITLES)


def is_transition(word: Column) -> Column:
    """A transition word."""
    return F.lower(F.regexp_replace(word, "[,;:]", "")).isin(*TRANSITIONS)


def pause(word: Column) -> Column:
    """Pause multiplier of a word, by the first rule that fits."""
    t = trimmed(word)
    ends = lambda p: t.rlike(p)
    short = (t.endswith(".") | ends("""\\.['"»]$""")) & is_abbreviation(F.regexp_replace(t, """["'»]+$""", ""))
    sentence = F.when(short, 1.0).when(ends("""[?]["'»]?$"""), QUESTION).when(ends("""[!]["'»]?$"""), EXCLAMATION).otherwise(END)
    comma = F.when(is_transition(F.regexp_replace(t, ",$", "")), COMMA + 0.2).otherwise(COMMA)
    rules = ((ends(r"\.{2,}$|…$"), F.lit(ELLIPSIS)), (ends("""[.!?]["'»]?$"""), sentence), (ends(r"[)\]]$"), F.lit(PAREN)), (ends("""["'»]$""") & ~ends("""^["'«]"""), F.lit(QUOTE)), (ends(";$"), F.lit(SEMICOLON)), (ends(":$"), F.lit(COLON)), (ends(",$"), comma), (ends("[-–—]$"), F.lit(DASH)), (is_transition(t), F.lit(TRANSITION)))
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(1.0)


_TRANSITIONS, _ABBREVIATED = frozenset(TRANSITIONS), frozenset(ABBREVIATIONS)
_ELLIPSIS_ENDS, _SENTENCE_ENDS, _STOP_ENDS = re.compile(r"\.{2,}\Z|…\Z"), re.compile("""([.!?])["'»]?\\Z"""), re.compile("""\\.["'»]?\\Z""")
_SHORT_WORD, _LETTERS = re.compile(r"[A-Z]{1,2}\.?"), re.compile(r"[a-zA-Z]\.([a-zA-Z]\.)+")


def pause_of(t: str) -> float:
    """D6 of one word without white space: what ``pause`` says of a column, for tasks that read whole texts word by word."""
    last = t[-1:]
    if last.isalnum():
        return TRANSITION if re.sub("[,;:]", "", t).lower() in _TRANSITIONS else 1.0
    if _ELLIPSIS_ENDS.search(t):
        return ELLIPSIS
    if m := _SENTENCE_ENDS.search(t):
        if _STOP_ENDS.search(t):
            abbreviation = t.rstrip("\"'»")
            bare_word = abbreviation.rstrip(".").lower()
            if bare_word in _ABBREVIATED or (len(bare_word) == 1 and bare_word.isascii() and bare_word.isalpha()) or _SHORT_WORD.fullmatch(abbreviation) or _LETTERS.fullmatch(abbreviation):
                return 1.0
        return QUESTION if m[1] == "?" else EXCLAMATION if m[1] == "!" else END
    if last in ")]":
        return PAREN
    if last in "\"'»" and t[0] not in "\"'«":
        return QUOTE
    if last == ",":
        return COMMA + 0.2 if re.sub("[,;:]", "", t[:-1]).lower() in _TRANSITIONS else COMMA
    return {";": SEMICOLON, ":": COLON, "-": DASH, "–": DASH, "—": DASH}.get(last) or (TRANSITION if re.sub("[,;:]", "", t).lower() in _TRANSITIONS else 1.0)


def sentence_pause(sentence: Column) -> Column:
    """Pause after a sentence."""
    return F.when(sentence.contains("!"), EXCLAMATION).when(sentence.contains("?"), QUESTION).when(sentence.rlike(r"\.{2,}|…"), ELLIPSIS).otherwise(END)


def recognition_point(word: Column) -> Column:
    """Letter to fix on, of letters, digits and underscores alone: 0 for one, 1 for up to five, else at three tenths."""
    n = F.length(F.regexp_replace(word, "[^A-Za-z0-9_]", ""))
    return F.when(n <= 1, 0).when(n <= 5, 1).otherwise(F.floor(n * 0.3)).cast("long")


def sentence_tokens(docs: DataFrame) -> DataFrame:
    """Sentences with offsets (code points, the white space after them included), words and pause; the rest without a mark has none."""
    pieces = _spans(docs, lambda t: [m.span() for m in _SENTENCE.finditer(t)], "sentence").withColumnRenamed("text", "piece")
    placed = pieces.withColumn("text", trimmed(F.col("piece"))).where("text <> ''")
    rest = F.when(F.col("piece").rlike("[.!?]"), sentence_pause(F.col("text"))).otherwise(1.0)
    return placed.select("doc_id", "sentence", "text", "start", "end", word_count(F.col("text")).alias("words"), rest.alias("pause"))


def chunks(docs: DataFrame, size: int, separator: str = "\n\n+") -> DataFrame:
    """D3: runs of ``size`` words inside paragraphs; the last of a paragraph, but for the text's last paragraph, pauses 3.0 at least."""
    break_, word = re.compile(separator), re.compile(f"[^{WHITE}]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for some in slices(batch):
                place, rows = [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    parts = break_.split(text or "")
                    for number, part in enumerate(parts):
                        words = word.findall(part)
                        for k, at in enumerate(range(0, len(words), size)):
                            own = words[at : at + size]
                            if (step := known.get(own[-1])) is None:
                                if len(known) >= KNOWN_WORDS:
                                    known.clear()
                                step = known[own[-1]] = pause_of(own[-1])
                            ends = at + size >= len(words) and number < len(parts) - 1
                            place.append(i)
                            rows.append((number, k, " ".join(own), max(step, 3.0) if ends else step, ends))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "paragraph", "chunk", "text", "pause", "paragraph_end"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, paragraph long, chunk long, text string, pause double, paragraph_end boolean")


def block_offsets(blocks: DataFrame) -> DataFrame:
    """For each block (doc_id, block, content) its words and the words before it."""
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.select("doc_id", F.col("block").cast("long").alias("block"), word_count(F.col("content")).alias("words"))
    return counted.select("*", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))


def positions_at(targets: DataFrame, offsets: DataFrame) -> DataFrame:
    """Block and word at a number of words (doc_id, target), at most the last word; the start where there are no blocks."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("block"))
    ends = offsets.withColumn("last", F.row_number().over(last) == 1).withColumnRenamed("doc_id", "owner")
    inside = (F.col("target") >= F.col("start")) & ((F.col("target") < F.col("start") + F.col("words")) | F.col("last"))
    joined = targets.join(ends, (F.col("doc_id") == F.col("owner")) & inside, "left")
    word = F.least(F.col("target") - F.col("start"), F.greatest(F.col("words") - 1, F.lit(0)))
    return joined.select("doc_id", "target", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce(word, F.lit(0)).alias("word"))


def folded(text: Column) -> Column:
    """lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BARE), "[\u0300-\u036f]", "")


class PhraseFinder:
    """F2 on whole texts: words are folded, letters and digits alone (words without either stay, as empty ones), and a match is a row of
    words that contain the words of a phrase.  Which words of the phrases a word contains is worked out once in a worker, as bits; known
    words are forgotten when they are ``MOST``."""

    MOST = KNOWN_WORDS
    WORD, OTHER = re.compile(f"[^{WHITE}]+"), re.compile(r"[\W_]")

    def __init__(self, phrases: Sequence[str]) -> None:
        wanted = [(p, terms) for p in phrases if p is not None and (terms := search_terms(p))]
        self.terms = list(dict.fromkeys(t for _, terms in wanted for t in terms))
        bit = {t: 1 << k for k, t in enumerate(self.terms)}
        self.phrases = [(p, [bit[t] for t in terms]) for p, terms in wanted]
        self.known: dict[str, int] = {}

    def _bits(self, word: str) -> int:
        if len(self.known) >= self.MOST:
            self.known.clear()
        plain = self.OTHER.sub("", bare(word.lower()))
        found = self.known[word] = sum(1 << k for k, t in enumerate(self.terms) if t in plain)
        return found

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(phrase, first word, last word) of the matches in a text."""
        known = self.known
        bits = [b if (b := known.get(w)) is not None else self._bits(w) for w in self.WORD.findall(text or "")]
        hot, out, n = [i for i, b in enumerate(bits) if b], [], len(bits)
        for phrase, (first, *rest) in self.phrases:
            for i in hot:
                if bits[i] & first and i + len(rest) < n and all(bits[i + k] & b for k, b in enumerate(rest, 1)):
                    out.append((phrase, i, i + len(rest)))
        return out


def phrase_matches(docs: DataFrame, phrases: Sequence[str], *keys: str) -> DataFrame:
    """places where consecutive words contain the words of a phrase, whatever case, accents and marks; of each document, or of
    each part of it (chapter, block) that the keys name. The texts are read once for all phrases (a list of the caller's), where they lie."""
    keys, phrases = keys or ("doc_id",), list(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PhraseFinder(phrases)
        for batch in batches:
            for part in slices(batch):
                found = [finder.find(t) for t in part.column(len(keys)).to_pylist()]
                place = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
                columns = list(zip(*(m for own in found for m in own), strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([*(c.take(place) for c in part.columns[:-1]), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], [*keys, "phrase", "start_word", "end_word"])

    fields = [T.StructField("phrase", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())]
    return docs.select(*keys, "text").mapInArrow(search, T.StructType([*(docs.schema[k] for k in keys), *fields]))


def search_terms(phrase: str) -> list[str]:
    """The words of a phrase, folded, letters and digits alone."""
    return ["".join(c for c in w if unicodedata.category(c)[0] in "LN") for w in bare(phrase.lower()).split()]
