"""Language, syllables, complexity, readability and reading times. Rules of words in a table are columns; readability adds up each whole
text in one pass (``text_sums``), each word worked out once in a worker, so one row of sums a document is shuffled, never the words.

Edge cases: null and blank texts have no words and get the defaults of readability; repeated ids are summed up together."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.common import WHITE, ratio, round_half_up, slices, split_words
from lectern.operators.text import ABBREVIATIONS, KNOWN_WORDS, TITLES, pause, pause_of, word_count

#: A mark that may end a sentence, with a quote and the space behind it; and lower case after space.
_MARK = re.compile(r"""[.!?]+["'»]?\s*""")
_LOWER = re.compile(r"\s*[a-z]")
#: Words that a full stop behind them makes an abbreviation: two capitals at most, or single letters with full stops.
_ABBREVIATIONS = frozenset(ABBREVIATIONS)
_SHORT = re.compile(r"[A-Z]{1,2}|[a-zA-Z](?:\.[a-zA-Z])+")
#: Syllables of words that the rules get wrong.
ENGLISH = (
    "queue 1 area 3 idea 3 real 2 being 2 seeing 2 doing 2 going 2 saying 2 rhythm 2 synth 1 myth 1 gym 1 lynx 1 hymn 1 crypt 1 prism 2 chasm 2 ion 2 lion 2 cafe 2 fiance 3 fiancee 3 naive 2 cliche 2 recipe 3 simile 3 adobe 3 coyote 3 karate 3 "
    "the 1 they 1 eye 1 aye 1 aisle 1 isle 1 every 2 different 3 interesting 4 comfortable 4 vegetable 4 chocolate 3 business 2 family 3 beautiful 3 favorite 3 evening 2 several 3 actually 4 usually 4 probably 3 definitely 4 especially 5 basically 4 "
    "temperature 4 literature 4 environment 4 experience 4"
)
NORWEGIAN = (
    "jeg 1 deg 1 seg 1 meg 1 nei 1 sei 1 hei 1 øye 2 øyne 2 øyene 3 seier 2 feier 2 leia 2 meia 2 veien 2 tiden 2 siden 2 livet 2 riket 2 hvordan 2 hvorfor 2 hvem 1 hva 1 hvor 1 hvit 1 kanskje 2 altså 2 derfor 2 fordi 2 eller 2 etter 2 under 2 over 2 "
    "mellom 2 gjennom 2 omkring 3 være 2 kunne 2 ville 2 skulle 2 måtte 2 burde 2 andre 2 første 2 mange 2 noen 2 ingen 2 alle 2 hver 1 bare 2 også 2 både 2 enda 2 hele 2 selv 1 egentlig 3 vanligvis 4 naturlig 3 tydelig 3 mulig 2 umulig 3 "
    "opplevelse 4 forståelse 4 betydelse 4 følelse 3"
)
#: Frequent words of the two languages.
NORWEGIAN_WORDS = "og jeg det er en på som med har til av for ikke den var om så han hun vi fra eller etter også nå når kan vil skal må her dit bare mange noen alle andre".split()
ENGLISH_WORDS = "the and is it to of in that for was on are with as be at this have from or by but not what all were we when your can there use an each which she do how their if".split()
#: Reading speed by level of difficulty, up to a grade; letters that count for tiers; speed by tier.
LEVELS = ((6, "easy", 1.15), (10, "medium", 1.0), (14, "hard", 0.9), (None, "very-hard", 0.8))
TIER_LETTERS = "a-zæøåàáâãäçèéêëìíîïñòóôõöùúûüýÿЀ-ӿ一-鿿぀-ゟ゠-ヿ"
SPEED = (0.7, 0.85, 1.0, 1.15, 1.3)
BANDS = ((90, "Very easy to read (5th grade)"), (80, "Easy to read (6th grade)"), (70, "Fairly easy (7th grade)"), (60, "Standard (8th-9th grade)"), (50, "Fairly difficult (10th-12th grade)"), (30, "Difficult (College level)"))
#: An end whose vowel is not spoken: e but for consonant and le, ed but after t and d, es but after a sibilant.
SILENT = r"(?:[^l]|[aeiouy]l)e$|.[^td]ed$|.[^szxhe]es$|[^cs]hes$|[^cg]ees$"
HYPHEN = "(?<=[a-zA-ZæøåÆØÅ])-(?=[a-zA-ZæøåÆØÅ])"


def by_count(table: str) -> dict[int, list[str]]:
    """The words of a table of syllables, by their count."""
    parts = table.split()
    out: dict[int, list[str]] = {}
    for word, n in zip(parts[::2], parts[1::2], strict=True):
        out.setdefault(int(n), []).append(word)
    return out


def letters(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[^a-zA-ZæøåÆØÅ]", ""))


def syllables(w: Column, language: Column, latin: Column | None = None) -> Column:
    """Syllables of the letters ``w`` of a word: none without letters, one up to two letters, else of the table, else runs of vowels."""
    latin = F.regexp_replace(w, "[^a-z]", "") if latin is None else latin
    english = F.when(F.length(latin) <= 2, 1).otherwise(F.greatest(F.lit(1), F.greatest(F.lit(1), F.regexp_count(latin, F.lit("[aeiouy]+"))) - latin.rlike(SILENT).cast("int")))
    norwegian = F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouyæøå]+")))
    out = F.when(F.length(w) == 0, 0).when(F.length(w) <= 2, 1)
    for code, table in (("en", ENGLISH), ("no", NORWEGIAN)):
        for n, words in by_count(table).items():
            out = out.when((language == code) & w.isin(*words), n)
    return out.when(language == "no", norwegian).otherwise(english).cast("long")


def spelled(words: DataFrame) -> DataFrame:
    """Adds letters, tier_letters (their number), latin and syllables to words (word, language), each worked out once."""
    out = words.withColumns({"letters": letters(F.col("word")), "tier_letters": F.length(F.regexp_replace(F.lower("word"), f"[^{TIER_LETTERS}]", ""))})
    out = out.withColumn("latin", F.regexp_replace("letters", "[^a-z]", ""))
    return out.withColumn("syllables", syllables(F.col("letters"), F.col("language"), F.col("latin")))


def with_dictionary(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Spelled words (word, language, letters, syllables, ...) whose syllables come from a dictionary (language, word, syllables) where
    it knows the letters and the built-in exceptions do not.  Words of up to two letters keep their one syllable; of repeated entries
    the greatest count holds; an empty dictionary changes nothing.  The words are read once; whether the dictionary is broadcast is left
    to Spark's limits, and where it is not, Spark cuts the part of a frequent word."""
    entry = dictionary.select("language", F.lower("word").alias("letters"), F.col("syllables").cast("long").alias("entry")).where("entry is not null").groupBy("language", "letters").agg(F.max("entry").alias("entry"))
    built_in = F.lit(False)
    for code, table in (("en", ENGLISH), ("no", NORWEGIAN)):
        built_in = built_in | ((F.col("language") == code) & F.col("letters").isin(*(w for own in by_count(table).values() for w in own)))
    open_ = entry.where(~built_in & (F.length("letters") > 2))
    return words.join(open_, ["language", "letters"], "left").withColumn("syllables", F.coalesce("entry", "syllables")).drop("entry").select(*words.columns)


def distinct_words(docs: DataFrame) -> DataFrame:
    """The distinct words (word, language) of texts. A task drops the repeats that it sees, so few words are shuffled."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, seen = _Words(), {"en": set(), "no": set()}

        def found() -> Iterator[pa.RecordBatch]:
            for language, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([language] * len(words), pa.string())], ["word", "language"])
                words.clear()

        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        seen[rules.language(text)].update(rules.WORD.findall(text))
                if sum(map(len, seen.values())) > KNOWN_WORDS:
                    yield from found()
        yield from found()

    return docs.select("text").mapInArrow(gather, "word string, language string").distinct()


def is_complex() -> Column:
    """E6, of spelled words: three syllables or more, also without ed, es and ing."""
    w = F.col("letters")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "ed$", ""), "es$", ""), "ing$", "")
    return (F.length(w) >= 3) & (F.col("syllables") >= 3) & (syllables(stem, F.col("language")) >= 3)


def language_of(text: Column) -> Column:
    """E4: 'no' by its own letters, or by frequent words; else 'en'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = ratio(F.regexp_count(low, F.lit("[æøå]")), F.length(low))
    words = F.transform(split_words(low), letters)
    score = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    no, en = score(NORWEGIAN_WORDS), score(ENGLISH_WORDS)
    return F.when((own > 0.001) | ((no > en * F.lit(1.5)) & (no > 3)), "no").otherwise("en")


def sentence_count(text: Column) -> Column:
    """Number of sentences, abbreviations in mind: as many as ``split_sentences`` gives, in Arrow batches."""
    return _sentence_count(text)


@F.pandas_udf(T.LongType())
def _sentence_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(split_sentences(t or "")) for t in texts], dtype="int64")


def sentences(docs: DataFrame) -> DataFrame:
    """The sentences (doc_id, sentence, text), trimmed."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [split_sentences(text or "") for text in part.column(1).to_pylist()]
                place = [i for i, own in enumerate(found) for _ in own]
                numbers = [k for own in found for k in range(len(own))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), pa.array(numbers, pa.int64()), pa.array([s for own in found for s in own], pa.string())], ["doc_id", "sentence", "text"])

    return docs.select("doc_id", "text").mapInArrow(split, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence long, text string")


def split_sentences(text: str) -> list[str]:
    """E1 on one text, in one pass over its marks: a mark ends a sentence, but not after an initial or a title, nor after another
    abbreviation where lower case follows.  The word before a mark may span marks ("U.S."), so its place is carried along."""
    marks = [(m.start(), m.end()) for m in _MARK.finditer(text)]
    out, begin, last, word_at = [], 0, 0, 0  # last: end of the mark before; word_at: where the last word before that begins
    for k, (at, end) in enumerate(marks):
        body = text[last:at].rstrip()
        if body:
            own = body.rsplit(None, 1)[-1]
            if len(own) < len(body) or last == begin or text[last - 1].isspace():
                word_at = last + len(body) - len(own)
            word = text[word_at : last + len(body)]
        else:
            word = text[word_at:last].rstrip() if last > begin else ""
        following = text[end : marks[k + 1][0] if k + 1 < len(marks) else len(text)]
        if word and _is_short(word) and (re.fullmatch(r"[A-Z]\.?", word) or word.lower().removesuffix(".") in TITLES or _LOWER.match(following)):
            if at == begin or text[at - 1].isspace():
                word_at = at  # a mark that stands alone
        else:
            out.append(text[begin:end])
            begin = word_at = end
        last = end
    return [s.strip() for s in (*out, text[begin:]) if s.strip()]


def _is_short(word: str) -> bool:
    """Whether a word, a full stop behind it, is an abbreviation."""
    bare = word.rstrip(".").lower()
    return bare in _ABBREVIATIONS or bool(_SHORT.fullmatch(word)) or (len(bare) == 1 and bare.isascii() and bare.isalpha())


def timing_words(text: Column) -> Column:
    """Words, hyphens between letters dividing them."""
    return word_count(text) + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(HYPHEN))


def complexity() -> Column:
    """D11, of spelled words: 0 to 1, by letters and syllables."""
    n, s = F.length("letters"), F.col("syllables")
    by_length, by_sound = F.least(F.lit(1.0), (n - 3) / F.lit(9.0)), F.least(F.lit(1.0), (s - 1) / F.lit(3.0))
    return F.when(n <= 2, 0.0).when(n <= 3, 0.1).otherwise(by_length * F.lit(0.4) + by_sound * F.lit(0.6))


def tier() -> Column:
    """D12, of spelled words: complexity tier, 1 to 5; 3 without letters."""
    n = F.col("tier_letters")
    by_length = F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 7, 3).when(n <= 10, 4).otherwise(5)
    by_sound = F.least(F.greatest(F.col("syllables"), F.lit(1)), F.lit(5))
    return F.when(n == 0, 3).otherwise(F.floor((by_length * 7 + by_sound * 3 + 5) / F.lit(10.0))).cast("long")


def speed(tiers: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SPEED)), tiers.cast("int"))


def word_duration(wpm: int | Column, adaptive: bool = True, pauses: bool = True) -> Column:
    """D13, of spelled words: milliseconds of a word, 80 at least."""
    out = (F.lit(60000.0) / wpm if isinstance(wpm, Column) else F.lit(60000.0 / wpm)) * (1 + F.regexp_count("word", F.lit(HYPHEN)))
    if adaptive:
        out = out * ((F.lit(0.7) + complexity() * F.lit(0.6)) * F.lit(0.4) + speed(tier()) * F.lit(0.6))
    return F.greatest(F.lit(80.0), out * pause(F.col("word")) if pauses else out)


def token_duration(wpm: Column, pauses: bool = True) -> Column:
    """D13, of chunks (text, pause): milliseconds of a chunk, without a least."""
    out = F.lit(60000.0) / wpm * timing_words(F.col("text"))
    return out * F.col("pause") if pauses else out


def sentence_duration(wpm: Column, pauses: bool = True) -> Column:
    """D13, of sentences (text, pause): milliseconds of a sentence, 300 at least."""
    return F.greatest(F.lit(300.0), token_duration(wpm, pauses))


def language_words(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys, language and one row a word; a text without words gives one row with a null word."""
    known = docs.select(*keys, "text", language_of(F.col("text")).alias("language"))
    return known.select(*keys, "language", F.explode_outer(split_words(F.col("text"))).alias("word"))


class _Words:
    """The rules of E2, E4 and E6 for whole texts, each word worked out once in a worker; the columns above say the same of words in a
    table.  Known words are forgotten when they are ``MOST``."""

    MOST = KNOWN_WORDS
    WORD, OTHER, NO_LETTER = re.compile(rf"[^{WHITE}]+"), re.compile("[^a-zA-ZæøåÆØÅ]"), re.compile(f"[^a-zæøå{WHITE}]+")
    NO_VOWELS, EN_VOWELS, NO_LATIN, SILENT = re.compile("[aeiouyæøå]+"), re.compile("[aeiouy]+"), re.compile("[^a-z]"), re.compile(SILENT)
    OTHER_TIER, HYPHEN = re.compile(f"[^{TIER_LETTERS}]"), re.compile(HYPHEN)
    TABLES = {code: {w: n for n, words in by_count(table).items() for w in words} for code, table in (("en", ENGLISH), ("no", NORWEGIAN))}
    NO, EN = frozenset(NORWEGIAN_WORDS), frozenset(ENGLISH_WORDS)

    def __init__(self) -> None:
        self.known: dict[str, dict[str, tuple[int, bool]]] = {"en": {}, "no": {}}

    def letters(self, word: str) -> str:
        return word.lower() if word.isascii() and word.isalpha() else self.OTHER.sub("", word).lower()

    def language(self, text: str) -> str:
        low = text.lower()
        if low and sum(map(low.count, "æøå")) / len(low) > 0.001:
            return "no"
        bare = self.NO_LETTER.sub("", low).replace("\ufeff", " ").split()  # words' letters alone; words without any do not count
        no, en = sum(map(self.NO.__contains__, bare)), sum(map(self.EN.__contains__, bare))
        return "no" if no > en * 1.5 and no > 3 else "en"

    def syllables(self, w: str, language: str) -> int:
        if len(w) <= 2:
            return min(len(w), 1)
        if (n := self.TABLES[language].get(w)) is not None:
            return n
        if language == "no":
            return max(1, len(self.NO_VOWELS.findall(w)))
        latin = w if w.isascii() else self.NO_LATIN.sub("", w)
        return 1 if len(latin) <= 2 else max(1, max(1, len(self.EN_VOWELS.findall(latin))) - bool(self.SILENT.search(latin)))

    def facts(self, word: str, language: str) -> tuple[int, bool]:
        """Syllables of a word, and whether it is complex."""
        known = self.known[language]
        if (found := known.get(word)) is None:
            if len(known) >= self.MOST:
                known.clear()
            w = self.letters(word)
            n = self.syllables(w, language)
            found = known[word] = n, n >= 3 and self.syllables(w.removesuffix("ed").removesuffix("es").removesuffix("ing"), language) >= 3
        return found

    def tier(self, word: str, language: str) -> int:
        """D12 of one word."""
        n, sound = len(self.OTHER_TIER.sub("", word.lower())), min(max(self.facts(word, language)[0], 1), 5)
        return 3 if n == 0 else ((1 if n <= 2 else 2 if n <= 4 else 3 if n <= 7 else 4 if n <= 10 else 5) * 7 + sound * 3 + 5) // 10

    def sums(self, text: str) -> tuple[str, int, int, int, int]:
        """Language, words, sentences, syllables and complex words of a text."""
        language = self.language(text)
        known, facts = self.known[language], []
        for w in self.WORD.findall(text):
            facts.append(known.get(w) or self.facts(w, language))
        return language, len(facts), len(split_sentences(text)), sum(f[0] for f in facts), sum(f[1] for f in facts)


SUMS = "language string, words long, sentences long, syllables long, complex_words long"


def text_sums(docs: DataFrame, *keys: str) -> DataFrame:
    """E5: the keys and the sums of each text, in one pass over it where it lies; no word is shuffled."""
    fields = [docs.schema[k] for k in keys]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in slices(batch):
                rows = [words.sums(t or "") for t in part.column(len(keys)).to_pylist()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], [*keys, "language", "words", "sentences", "syllables", "complex_words"])

    return docs.select(*keys, "text").mapInArrow(add_up, T.StructType([*fields, *T.StructType.fromDDL(SUMS)]))


def tier_counts(docs: DataFrame) -> DataFrame:
    """Words of each tier in each document that has words, counted where its text lies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, known = _Words(), {"en": {}, "no": {}}
        for batch in batches:
            for part in slices(batch):
                rows = np.zeros((part.num_rows, 6), np.int64)
                for i, text in enumerate(part.column(1).to_pylist()):
                    language = rules.language(text or "")
                    own = known[language]
                    for word, n in Counter(rules.WORD.findall(text or "")).items():
                        if (t := own.get(word)) is None:
                            if len(own) >= rules.MOST:
                                own.clear()
                            t = own[word] = rules.tier(word, language)
                        rows[i, t] += n
                full = rows.any(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(full)), *(pa.array(rows[full, t]) for t in range(1, 6))], ["doc_id", *tiers])

    tiers = [f"tier_{t}" for t in range(1, 6)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, {', '.join(f'{t} long' for t in tiers)}")
    return counted.groupBy("doc_id").agg(*(F.sum(t).alias(t) for t in tiers))


class WordTimes:
    """D13 of the words of texts, by the English rules: what ``word_duration`` says of a column. Numbers of words, and for each number
    what its time is multiplied by; known words are forgotten when they are ``KNOWN_WORDS``."""

    def __init__(self, adaptive: bool) -> None:
        self.rules, self.adaptive = _Words(), adaptive
        self.known: dict[str, int] = {}
        self.factors = np.empty((KNOWN_WORDS, 3))

    def _number(self, word: str) -> int:
        n = self.known[word] = len(self.known)
        letters, sound = len(self.rules.letters(word)), self.rules.facts(word, "en")[0]
        complexity = 0.0 if letters <= 2 else 0.1 if letters <= 3 else min(1.0, (letters - 3) / 9.0) * 0.4 + min(1.0, (sound - 1) / 3.0) * 0.6
        fitted = (0.7 + complexity * 0.6) * 0.4 + SPEED[self.rules.tier(word, "en") - 1] * 0.6 if self.adaptive else 1.0
        self.factors[n] = 1 + len(self.rules.HYPHEN.findall(word)), fitted, pause_of(word)
        return n

    def of(self, text: str, wpm: int) -> np.ndarray:
        """Milliseconds of the words of a text, 80 at least."""
        known, out = self.known, []
        words = self.rules.WORD.findall(text)
        for at in range(0, len(words), KNOWN_WORDS):
            some = words[at : at + KNOWN_WORDS]
            if len(known) + len(some) > KNOWN_WORDS:
                known.clear()
            hyphens, fitted, pauses = self.factors[[n if (n := known.get(w)) is not None else self._number(w) for w in some]].T
            out.append(np.maximum(80.0, 60000.0 / wpm * hyphens * fitted * pauses))
        return np.concatenate(out) if out else np.empty(0)


def _tenth(x: Column, unit: float = 10.0) -> Column:
    return round_half_up(x * F.lit(unit)) / F.lit(unit)


def readability(docs: DataFrame, *keys: str) -> DataFrame:
    """Sums and indices of each group of the keys (a document, or a block of it)."""
    keys = keys or ("doc_id",)
    sums = text_sums(docs, *keys).groupBy(*keys, "language", "sentences").agg(*(F.sum(c).alias(c) for c in ("words", "syllables", "complex_words")))
    per_sentence, per_word, share = ratio(F.col("words"), F.col("sentences")), ratio(F.col("syllables"), F.col("words")), ratio(F.col("complex_words"), F.col("words")) * F.lit(100.0)
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word))
    grade = F.greatest(F.lit(0.0), F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59))
    fog = F.lit(0.4) * (per_sentence + share)
    out = sums.withColumns({"ease": ease, "grade": grade, "fog": fog, "per_sentence": per_sentence, "per_word": per_word, "share": share})
    smog = F.lit(1.043) * F.sqrt(F.col("complex_words") * (F.lit(30.0) / F.col("sentences"))) + F.lit(3.1291)
    out = out.withColumn("smog", F.when(F.col("sentences") >= 3, smog).otherwise(F.col("grade")))
    out = out.withColumn("composite", F.col("grade") * F.lit(0.4) + F.col("fog") * F.lit(0.3) + F.col("smog") * F.lit(0.3))
    read = (F.col("words") > 0) & (F.col("sentences") > 0)
    level, factor = F.when(~read, "easy"), F.when(~read, 1.0)
    for most, name, value in LEVELS:
        inside = F.lit(True) if most is None else F.col("composite") <= most
        level, factor = level.when(inside, name), factor.when(inside, value)
    shown = {"flesch_ease": ("ease", 10.0, 100.0), "flesch_grade": ("grade", 10.0, 0.0), "fog_index": ("fog", 10.0, 0.0), "smog_index": ("smog", 10.0, 0.0), "words_per_sentence": ("per_sentence", 10.0, 0.0), "syllables_per_word": ("per_word", 100.0, 0.0), "complex_percent": ("share", 10.0, 0.0)}
    return out.select(*keys, "language", "words", "sentences", "syllables", "complex_words", *(F.when(read, _tenth(F.col(c), u)).otherwise(d).alias(n) for n, (c, u, d) in shown.items()), level.alias("level"), factor.alias("wpm_factor"))


def described(scores: DataFrame, wpm: int) -> DataFrame:
    """Label of the reading level and speed fitted to it."""
    label = F.when(F.col("flesch_ease") >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        label = label.when(F.col("flesch_ease") >= least, name)
    last = F.concat(F.lit("Very difficult (Grade "), round_half_up(F.col("flesch_grade")).cast("string"), F.lit("+)"))
    return scores.withColumns({"description": label.otherwise(last), "adjusted_wpm": round_half_up(F.lit(wpm) * F.col("wpm_factor"))})


def report(scores: DataFrame) -> DataFrame:
    """The report of each text: label, the four indices, language, and what it means for the reading speed."""
    off = round_half_up((F.lit(1.0) - F.col("wpm_factor")) * 100.0).cast("string")
    on = round_half_up((F.col("wpm_factor") - F.lit(1.0)) * 100.0).cast("string")
    slower = F.concat(F.lit("Consider reading "), off, F.lit("% slower for better comprehension"))
    faster = F.concat(F.lit("This text is easy - you can read "), on, F.lit("% faster"))
    advice = F.when(F.col("wpm_factor") < 1, slower).when(F.col("wpm_factor") > 1, faster).otherwise("Normal reading speed recommended")
    return described(scores, 1).select("doc_id", F.col("description").alias("summary"), "flesch_ease", "flesch_grade", "fog_index", "smog_index", advice.alias("recommendation"), "language")
