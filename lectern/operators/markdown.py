"""Markdown and pasted texts to typed blocks: lines get a class where the text lies, runs of lines are blocks, and what is written inside
a line goes by the columns of ``text``.

Edge cases: null, empty and blank texts have no blocks; an open fence ends with its text; line ends of all kinds count; repeated rows each
give their blocks; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.common import slices
from lectern.operators.blocks import article_blocks
from lectern.operators.identity import text_hash
from lectern.operators.text import is_markdown, paragraphs, without_inline_markdown

UNTITLED = "Pasted Text"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:[ \t]+(?=\S)|[ \t]*$)")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
#: type, level, ordered, parts (items of a list; else pieces that a space joins), language
Found = tuple[str, int | None, bool | None, list[str], str | None]


def _opens(line: str, following: str) -> str | None:
    """The class of a line that begins a block of its own, in the order in which the rules count."""
    for kind, pattern in (("fence", _FENCE), ("heading", _HEADING), ("rule", _RULE), ("quote", _QUOTE), ("item", _ITEM)):
        if pattern.match(line):
            return kind
    return "table" if "|" in line and _DELIMITERS.match(following) and line.count("|") >= following.count("|") - 1 > -1 and "|" in following else None


def line_blocks(text: str) -> list[Found]:
    """Blocks of a Markdown text, in one pass over its lines."""
    lines = [x.expandtabs(4) for x in re.split(r"\r\n|\r|\n", text)]
    out: list[Found] = []
    i, n = 0, len(lines) - (lines[-1] == "")
    lines.append("")
    while i < n:
        line = lines[i]
        kind = "blank" if not line.strip() else _opens(line, lines[i + 1]) or ("code" if line.startswith("    ") else "definition" if _DEFINITION.match(line) else "text")
        begin, i = i, i + 1
        if kind == "fence":
            mark, language = _FENCE.match(line).groups()
            closes = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while i < n and not closes.match(lines[i]):
                i += 1
            out.append(("code", None, None, ["\n".join(lines[begin + 1 : i])], language or None))
            i += 1
        elif kind == "heading":
            marks, title = _HEADING.match(line).groups()
            out.append(("heading", len(marks), None, [title or ""], None))
        elif kind == "code":
            while i < n and (lines[i].startswith("    ") or not lines[i].strip()):
                i += 1
            out.append(("code", None, None, ["\n".join(x[4:] for x in lines[begin:i]).rstrip()], None))
        elif kind == "quote":
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or not _opens(lines[i], lines[i + 1])):
                i += 1
            inner = line_blocks("\n".join(_QUOTE.sub("", x, count=1) for x in lines[begin:i]))
            out.append(("quote", None, None, [p for b in inner if b[0] != "list" for p in b[3]], None))
        elif kind == "item":
            i, found = _list(lines, begin, n)
            out.append(found)
        elif kind == "table":
            while i < n and lines[i].strip() and _opens(lines[i], "") is None:
                i += 1
        elif kind == "text":
            while i < n and lines[i].strip() and _opens(lines[i], lines[i + 1]) is None and not _UNDERLINE.match(lines[i]):
                i += 1
            paragraph = "\n".join(x.strip() for x in lines[begin:i])
            if i < n and (under := _UNDERLINE.match(lines[i])):
                out.append(("heading", 1 if under[1][0] == "=" else 2, None, [paragraph], None))
                i += 1
            else:
                out.append(("paragraph", None, None, [paragraph], None))
    return out


def _list(lines: list[str], at: int, n: int) -> tuple[int, Found]:
    """The list that begins at a line: items with one kind of mark, each with the lines that are indented under it or go on with it."""
    first = _ITEM.match(lines[at])[2]
    same = (lambda m: m[-1] == first[-1] and m[:-1].isdigit()) if first[:-1].isdigit() else (lambda m: m == first)
    items: list[list[str]] = []
    while at < n and (m := _ITEM.match(lines[at])) and same(m[2]) and not _RULE.match(lines[at]):
        inside, own = len(m[0]) if lines[at][len(m[0]) :] else len(m[1]) + len(m[2]) + 1, [lines[at][len(m[0]) :]]
        at += 1
        while at < n:
            line = lines[at]
            if not line.strip():
                following = next((k for k in range(at, n) if lines[k].strip()), n)
                if following < n and lines[following].startswith(" " * inside):
                    own += [""] * (following - at)
                    at = following
                    continue
                break
            if line.startswith(" " * inside):
                own.append(line[inside:])
            elif _opens(line, lines[at + 1]) is None and lines[at - 1].strip():
                own.append(line.strip())
            else:
                break
            at += 1
        items.append(own)
        following = next((k for k in range(at, n) if lines[k].strip()), n)
        if following < n and (m := _ITEM.match(lines[following])) and same(m[2]):
            at = following
    return at, ("list", None, first[:-1].isdigit(), ["\n".join(x).strip() for x in items], None)


_PARTS = [T.StructField("block", T.LongType()), T.StructField("type", T.StringType()), T.StructField("level", T.LongType()), T.StructField("ordered", T.BooleanType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("language", T.StringType())]


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown texts (doc_id, text): doc_id, block, type (heading, paragraph, list, quote, code), level, ordered, content,
    items, language.  Marks inside lines are taken out, but not of code; rules, tables and definitions of links have no block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [line_blocks(t or "") for t in part.column(1).to_pylist()]
                place = [i for i, own in enumerate(found) for _ in own]
                columns = list(zip(*(b for own in found for b in own), strict=True)) or [()] * 5
                number = [k for own in found for k in range(len(own))]
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), pa.array(number, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f.name for f in _PARTS)])

    rows = docs.select("doc_id", "text").mapInArrow(read, T.StructType([docs.schema["doc_id"], *_PARTS]))
    plain = F.when(F.col("type") == "code", F.col("parts")).otherwise(F.transform("parts", without_inline_markdown))
    shown = rows.withColumn("parts", plain)
    content = F.when(F.col("type") != "list", F.array_join("parts", " "))
    return shown.select("doc_id", "block", "type", "level", "ordered", content.alias("content"), F.when(F.col("type") == "list", F.col("parts")).alias("items"), "language")


def pasted_documents(docs: DataFrame) -> DataFrame:
    """Pasted texts (doc_id, text) as documents: title (the first h1 of Markdown), source, text hash, and the blocks in order.  Texts
    that look like Markdown go by B3, the others by B1 and B6 without its strict rules.  Repeated ids are one document each id."""
    mark = is_markdown(F.coalesce("text", F.lit("")))
    written = markdown_blocks(docs.where(mark))
    plain = paragraphs(docs.where(~mark)).select("doc_id", F.col("block").cast("long").alias("block"), F.lit("paragraph").alias("type"), "content")
    kept = article_blocks(plain, strict=False)
    columns = ["doc_id", "block", "type", "level", "ordered", "content", "items", "language"]
    block = F.struct(*columns[1:])
    every = written.select(columns).unionByName(kept, allowMissingColumns=True)
    title = F.min_by(F.when(F.col("level") == 1, F.col("content")), F.when(F.col("level") == 1, F.col("block")))
    gathered = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), title.alias("title"))
    named = docs.select("doc_id", text_hash(F.coalesce("text", F.lit(""))).alias("file_hash"))
    return named.join(gathered, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(UNTITLED)).alias("title"), F.lit("paste").alias("source"), "file_hash", F.coalesce("blocks", F.array().cast(gathered.schema["blocks"].dataType)).alias("blocks"))


def titles(docs: DataFrame) -> DataFrame:
    """The first h1 of each Markdown text that has one."""
    return markdown_blocks(docs).where("level = 1").groupBy("doc_id").agg(F.min_by("content", "block").alias("title"))
