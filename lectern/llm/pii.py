"""Operator 5: personal data by candidates, boosted trees and calibrated thresholds.

Base spans follow fixed formats (email, ip, card, phone) and are always reported.  Beyond them, generators of high recall
propose overlapping candidates of each kind, in looser formats: addresses with spelt-out marks, numbers with other
separators, telephone numbers without a country code, octets with other marks, and numbers that the base formats lose because
another number stands beside them.  Boosted trees score a candidate by its format and its context, and those over their kind's
threshold that overlap no base span and no longer or better such candidate are added.

Training: no table marks personal data, so the trees learn from the corpus itself.  Positive are base spans, and their
loose forms, in their own contexts, beside other numbers and behind words that announce them.  Negative are candidates that their
kind's format rules out (a failed check digit, octets over 255, prose around "at"), and numbers that are made of a base span's
digits but are something else (dates, amounts, order numbers, runs inside a code).  Loose candidates of which nothing is known are
not learnt from.  Every text with a candidate is learnt from.  Equal examples are counted where they lie and added up by Spark,
first with their features, then with the bins of these, so the driver gets distinct rows of bins with their numbers, and trees
fitted to these are those of all examples.  A third, by text, calibrates: the threshold of a kind is the lowest score from which on
at least ``PRECISION`` of its examples are positive, and 1 where none is.

Places are code points, ends exclusive.  All searches are linear in the text, whatever runs it holds.

Edge cases: null and empty texts have no spans; repeated rows give repeated results; with no base span to learn from, only
base spans are reported; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, slices, tidy

#: The kinds in their order and the formats of base spans. A look behind, or a quantifier that gives nothing back,
#: only spares attempts that cannot match.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
EMAIL, EMAIL_HERE = re.compile(rf"(?<!{_LOCAL}){_EMAIL}"), re.compile(_EMAIL)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators of candidates. Those of addresses start from the mark between name and host.
AT = re.compile(r"\s?(?:@|\[at\]|\(at\)|\{at\}| at )\s?")
NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}| dot )\s?[A-Za-z0-9-]{1,63}){1,4}")
LOOSE = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
}
#: One number alone, for those that the generators join with a neighbour.
ALONE = {"card": re.compile(r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"), "phone": re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")}
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "addr", "host", "server"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax")}
OTHER_CUES = ("order", "no.", "id", "version", "ref", "isbn", "page", "total", "price", "invoice", "date", "code", "token", "key")
NEAR = 24
PRECISION = 0.98
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 16
_DIGIT, _MARKED = re.compile("[0-9]"), re.compile(r"@|\[|\(|\{| dot ")
_workers: dict = {}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octet(s: str) -> bool:
    return len(s := s.lstrip("0")) <= 3 and int(s or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base format: a name's run begins where no character of one stands before, or at the
    end of the match before it."""
    at = 0
    while at < len(text):
        m = EMAIL_HERE.match(text, at) if at else None
        m = m or EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base spans, by start, then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(octet(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """(start, kind, end) that the generators propose, in order; spans overlap."""
    found = set()
    for m in AT.finditer(text):
        name, host = NAME.search(text, max(0, m.start() - 64), m.start()), HOST.match(text, m.end())
        if name and host:
            found.add((name.start(), 0, host.end()))
    if _DIGIT.search(text):
        for some in (LOOSE, ALONE):
            for kind, pattern in some.items():
                k = KINDS.index(kind)
                found.update((m.start(), k, m.end()) for m in pattern.finditer(text))
    return sorted(found)


def ruled_out(span: str, kind: int) -> bool:
    """Whether a candidate cannot be personal data of its kind by its format alone."""
    if kind == 0:
        return not _MARKED.search(span)  # prose around "at"
    if kind == 1:
        return not all(octet(x) for x in re.findall("[0-9]+", span))
    d = digits_of(span)
    if kind == 2:
        return not (12 <= len(d) <= 19 and luhn(d))
    return not 7 <= len(d) <= 15


def features(before: str, span: str, after: str, kind: int) -> list[float]:
    """Format and context of a candidate."""
    d = digits_of(span)
    groups = re.findall("[0-9]+", span)
    marks = re.findall(r"[^0-9A-Za-z]+", span)
    last = re.split(r"[^A-Za-z0-9-]+", span)[-1]
    context, low = before.lower(), span.lower()
    size = [len(g) for g in groups] or [0]
    return [
        float(kind), len(span), len(d), len(groups), max(size), min(size), size[0], size[-1], size[-2] if len(size) > 1 else 0,
        len(marks), len(set(marks)), float(span[0] == "+"), float(span[:2] == "00"), span.count("("), float(bool(d) and luhn(d)), float(bool(groups) and all(map(octet, groups))), float(all(len(g) < 2 or g[0] != "0" for g in groups)),
        len(d) / len(span), float("@" in span), float(bool(_MARKED.search(span))), float("dot" in low), len(last), float(last.isalpha()), float(last.islower()), span.count("."), span.count("-"), span.count("/"), span.count(" "), span.count(":"),
        float(size[0] == 4 and groups[0][:2] in ("19", "20")), float(size[-1] == 4 and groups[-1][:2] in ("19", "20")),
        *(float(any(c in context for c in cues)) for cues in CUES.values()), float(any(c in context for c in OTHER_CUES)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.search(r"[0-9][.,:/-]?$", before))), float(bool(re.match(r"[.,:/-]?[0-9]", after))), float(before[-1:] in "#$€£=/_" and bool(before)),
    ]


def example(text: str, start: int, kind: int, end: int) -> list[float]:
    return features(text[max(0, start - NEAR) : start], text[start:end], text[end : end + NEAR], kind)


def loose_forms(span: str, kind: int) -> list[str]:
    """A base span as looser formats write it."""
    d = digits_of(span)
    if kind == 0:
        name, _, host = span.partition("@")
        return [f"{name} [at] {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name}(at){host.replace('.', '(dot)')}", f"{name} @ {host}"]
    if kind == 1:
        return [span.replace(".", mark) for mark in ("[.]", "(.)")]
    if kind == 2:
        return [mark.join(d[i : i + 4] for i in range(0, len(d), 4)) for mark in ("./_"[len(d) % 3], "  ")]
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return [f"({a}) {b}-{c}", f"00{d}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d}", f"{a} {b} {c}"] if len(a) == 3 else [f"00{d}", f"+{d}"]


def other_numbers(digits: str) -> list[str]:
    """Numbers that are no personal data, of these digits."""
    d = (digits * 4)[:20]
    year, month, day = f"{19 + int(d[0]) % 2}{d[1:3]}", f"{1 + int(d[3:5]) % 12:02}", f"{1 + int(d[5:7]) % 28:02}"
    return [f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}{month}{day}", f"{year}-{month}-{day} {int(d[7:9]) % 24:02}:{d[9]}0", d[:8], d[2:12], f"{d[:3]}.{d[3:9]}", f"{d[0]} {d[1:4]} {d[4:7]}", f"{d[:2]}-{d[2:9]}", d[:15], d[:17]]


def examples(text: str) -> list[tuple[list[float], int, int]]:
    """(features, kind, label) of a text's base spans, their loose forms, other numbers, and candidates that are ruled out."""
    base, out = base_spans(text), []
    own = {(s, k, e) for s, k, e in base}
    for s, k, e in base:
        before, after, span = text[max(0, s - NEAR) : s], text[e : e + NEAR], text[s:e]
        turn = s + e
        cue = CUES[KINDS[k]][turn % len(CUES[KINDS[k]])]
        out.append((features(before, span, after, k), k, 1))
        for form in [span, *loose_forms(span, k)]:
            out.append((features(before, form, after, k), k, 1))
            out.append((features(f"{before[: NEAR // 2]} {cue}{' ' if turn % 2 else ': '}"[-NEAR:], form, after, k), k, 1))
        if k > 1:
            d = digits_of(span)
            out.append((features(before, span, f" {d[::-1]} ", k), k, 1))  # beside another number
            out.append((features(f"{before[: NEAR // 2]} {d[::-1]} ", span, after, k), k, 1))
            code = f"{d[:6]}ab{d[:2]}"
            out += [(features(f"{before[:8]} {lead}", d, f"{tail} ", k), k, 0) for lead, tail in ((code, f"{code}f"), ("", code), ("#", ""))]
            bad = span[:-1] + str((int(span[-1]) + 1) % 10)
            if k == 2:
                out.append((features(before, bad, after, k), k, 0))
                out += [(features(before, form[:14], form[14:] + after, 3), 3, 0) for form in loose_forms(span, k)]
            else:
                out.append((features(f"{before[: NEAR // 2]} {cue} ", d[-10:], after, k), k, 1))
            for i, number in enumerate(other_numbers(d)):
                for kind in (2, 3):
                    if LOOSE[KINDS[kind]].fullmatch(number) and not (kind == 2 and luhn(digits_of(number))):
                        out.append((features(before, number, after, kind), kind, 0))
                        word = OTHER_CUES[(turn + i) % len(OTHER_CUES)]
                        out.append((features(f"{before[: NEAR // 2]} {word} ", number, after, kind), kind, 0))
            word = OTHER_CUES[turn % len(OTHER_CUES)]
            out.append((features(f"{before[: NEAR // 2]} {word} ", d[-10:], after, 3), 3, 0))
    out += [(example(text, s, k, e), k, 0) for s, k, e in candidates(text) if (s, k, e) not in own and ruled_out(text[s:e], k)]
    return out


class Trees:
    """Boosted trees for log loss, with binned features; and a threshold for each kind."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        self.start, self.threshold = 0.0, [1.0] * len(KINDS)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, b: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        """From binned rows, each of which counts ``times``."""
        n, width = len(b), b.shape[1]
        p = ((y * times).sum() + 1) / (times.sum() + 2)
        self.start = float(np.log(p / (1 - p)))
        value = np.full(n, self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-value))
            g, h = (y - q) * times, q * (1 - q) * times
            leaf, splits = np.zeros(n, np.int64), []
            for depth in range(DEPTH):  # one split for all leaves of a level
                gain = np.full((width, BINS), -np.inf)
                size = (1 << depth) * (BINS + 1)
                for j in range(width):
                    cell = leaf * (BINS + 1) + b[:, j]
                    sg, sh = np.bincount(cell, g, size).reshape(-1, BINS + 1), np.bincount(cell, h, size).reshape(-1, BINS + 1)
                    lg, lh = sg.cumsum(1)[:, :-1], sh.cumsum(1)[:, :-1]
                    rg, rh = sg.sum(1)[:, None] - lg, sh.sum(1)[:, None] - lh
                    gain[j] = (lg**2 / (lh + 1) + rg**2 / (rh + 1)).sum(0)
                j, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
                splits.append((int(j), int(cut)))
                leaf = 2 * leaf + (b[:, j] > cut)
            weight = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
            value += weight[leaf]
            self.trees.append((splits, weight))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scores_of_bins(self.binned(x))

    def scores_of_bins(self, b: np.ndarray) -> np.ndarray:
        value = np.full(len(b), self.start)
        for splits, weight in self.trees:
            leaf = np.zeros(len(b), np.int64)
            for j, cut in splits:
                leaf = 2 * leaf + (b[:, j] > cut)
            value += weight[leaf]
        return 1 / (1 + np.exp(-value))

    def calibrate(self, b: np.ndarray, y: np.ndarray, kind: np.ndarray, times: np.ndarray) -> None:
        s = self.scores_of_bins(b)
        for k in range(len(KINDS)):
            own = kind == k
            score, place = np.unique(-s[own], return_inverse=True)  # the highest first; rows of one score stand or fall together
            n, good = np.bincount(place, times[own]), np.bincount(place, (times * y)[own])
            enough = np.flatnonzero(np.cumsum(good) / (np.cumsum(n) + 1 / max(1, n.sum())) >= PRECISION)
            self.threshold[k] = float(max(0.5, -score[enough[-1]])) if n[enough].sum() >= 10 else 1.0


def fit(docs: DataFrame, text_col: str = "text") -> Trees | None:
    """Trees and thresholds from the examples of all texts."""
    fields = ("kind", "label", "part")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                n = Counter((tuple(f), k, y, p) for p, text in zip(*(c.to_pylist() for c in rows.columns), strict=True) for f, k, y in examples(text))
                columns = list(zip(*n, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.float64())), *(pa.array(c, pa.int32()) for c in columns[1:]), pa.array(n.values(), pa.int64())], ["f", *fields, "n"])

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = trees.binned(np.array(batch.column(0).to_pylist())).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *batch.columns[1:]], ["bins", *fields, "n"])

    def added_up(rows: DataFrame, what: str) -> DataFrame:
        return rows.groupBy(what, *fields).agg(F.sum("n").alias("n"))

    trees, scratch, held = Trees(), Scratch(docs.sparkSession), ", ".join(f"{c} int" for c in fields)
    likely = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = likely.select(F.pmod(F.xxhash64("text"), F.lit(3)).alias("part"), "text").mapInArrow(tidy(learn), f"f array<double>, {held}, n long")
    known = scratch.write(added_up(found, "f"), "examples")
    values = known.where("part > 0").select(F.posexplode("f").alias("feature", "value")).distinct().toPandas()
    if not len(values):
        scratch.clear()
        return None
    # between distinct values, so that a mark that few examples have still counts
    trees.edges = [np.unique(np.quantile(own["value"], np.linspace(0, 1, BINS + 1)[1:-1])) for _, own in values.groupby("feature")]
    rows = added_up(known.mapInArrow(bin_, f"bins binary, {held}, n long"), "bins").toPandas().sort_values(["bins", *fields])  # sums of doubles hang on their order
    scratch.clear()
    if rows["label"].nunique() < 2:
        return None
    b = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), -1).astype(np.int64)
    y, kind, part, times = (rows[c].to_numpy(t) for c, t in (("label", float), ("kind", int), ("part", int), ("n", float)))
    trees.fit(b[part > 0], y[part > 0], times[part > 0])
    trees.calibrate(b[part == 0], y[part == 0], kind[part == 0], times[part == 0])
    return trees


def disjoint(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover together."""
    starts, ends = [], []
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def overlaps(starts: list[int], ends: list[int], s: int, e: int) -> bool:
    k = bisect_left(starts, e) - 1
    return k >= 0 and ends[k] > s


def all_spans(text: str, trees: Trees | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the added ones, by start, then kind."""
    base = base_spans(text)
    if trees is None:
        return base, base
    taken = disjoint(base)
    free = [c for c in candidates(text) if not overlaps(*taken, c[0], c[2]) and not ruled_out(text[c[0] : c[2]], c[1])]
    if not free:
        return base, base
    score = trees.scores(np.array([example(text, *c) for c in free]))
    added: list[Span] = []
    starts, ends = [], []
    for i in np.lexsort((-score, [s - e for s, _, e in free])).tolist():  # the longest first: parts of a number are numbers too
        s, k, e = free[i]
        if score[i] >= trees.threshold[k] < 1 and not overlaps(starts, ends, s, e):
            added.append(free[i])
            insort(starts, s)
            insort(ends, e)
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover as its first span's kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out.append(f"{text[at:s]}[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a count of base spans of each kind, base (text form of the base spans) and spans (of all spans)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    held, key = spark.sparkContext.broadcast(fit(docs, text_col)), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = held.value
        trees = _workers[key]
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                found = [all_spans(t or "", trees) for t in texts]
                counts = [pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
                cols = [part.column(0), *counts, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base", "spans"]
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string"
    return read.mapInArrow(tidy(find), schema).withColumnRenamed("id", id_col)


def redacted_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows with each span in ``text_col`` as its kind in brackets, and the text's length in ``length_col``; a null text
    stays null, the other columns stay as they are."""
    held, key = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col)), uuid.uuid4().hex
    place = docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = held.value
        for batch in batches:
            for part in slices(batch):
                texts = [None if t is None else redacted(t, all_spans(t, _workers[key])[1]) for t in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    out = docs.mapInArrow(tidy(redact), docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out
