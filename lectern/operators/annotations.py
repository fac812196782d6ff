"""Annotations: filters, groups, tags, counts, order and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import trimmed

FORMATS = ("markdown", "text", "html", "json")

def filtered(notes: DataFrame, color: str | None = None, tag: str | None = None, favorite: bool = False, search: str = "") -> DataFrame:
    """By color, tag, favourite, and a text that the annotated text, the note, a tag or the document's title contains (of those columns
    that there are), whatever its case; a blank one fits all."""
    if typed := search.strip().lower():
        found = F.lit(False)
        for c in ("text", "note", "title"):
            if c in notes.columns:
                found = found | F.coalesce(F.lower(c).contains(typed), F.lit(False))
        if "tags" in notes.columns:
            found = found | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(typed)), F.lit(False))
        notes = notes.where(found)
    out = notes.where(F.col("color") == color) if color else notes
    out = out.where(F.array_contains("tags", tag)) if tag else out
    return out.where("favorite") if favorite else out


def by_document(notes: DataFrame) -> DataFrame:
    """Annotations of each document and the latest date."""
    return notes.groupBy("doc_key").agg(F.count("*").alias("n"), F.max("created").alias("latest"))


def by_date(notes: DataFrame) -> DataFrame:
    """All annotations, newest first: their place by date, then position and id."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created"), "start_block", "start_word", "id")
    return notes.select("user_id", "id", "created", F.row_number().over(order).cast("long").alias("place"))


def by_tag(notes: DataFrame) -> DataFrame:
    """Annotations of each tag; those without tags are ``Untagged``."""
    return notes.select(F.explode_outer("tags").alias("tag")).groupBy(F.coalesce("tag", F.lit("Untagged")).alias("tag")).agg(F.count("*").alias("n"))


def totals(notes: DataFrame) -> DataFrame:
    """All, with notes, favourites, documents."""
    return notes.agg(F.count("*").alias("total"), F.count("note").alias("with_notes"), F.count_if("favorite").alias("favorites"), F.count_distinct("doc_key").alias("documents"))


def by_color(notes: DataFrame, palette: tuple[str, ...]) -> DataFrame:
    """Annotations of each color of the palette, zero included."""
    colors = notes.sparkSession.createDataFrame([(c,) for c in palette], "color string")
    found = notes.groupBy("color").agg(F.count("*").alias("n"))
    return colors.join(found, "color", "left").select("color", F.coalesce("n", F.lit(0)).alias("n"))


def positions(notes: DataFrame) -> DataFrame:
    """Place of each annotation in its document, by block, then word."""
    return notes.select("doc_key", "id", F.row_number().over(_in_place(notes)).cast("long").alias("place"))


def _in_place(notes: DataFrame):
    """Order of a document's annotations: by block, word and id, then by whatever else they have, so that rows with one id have one order."""
    rest = [c for c in ("color", "note", "favorite", "created", "end_block", "end_word", "tags") if c in notes.columns]
    return Window.partitionBy("doc_key").orderBy("start_block", "start_word", "id", *rest)


def block_number(block_id: Column) -> Column:
    """Number that a block id begins with, else 0."""
    return F.coalesce(F.regexp_extract(block_id, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def touching(notes: DataFrame) -> DataFrame:
    """Annotations that cover each block, from the first to the last: a row for each document and block."""
    covered = notes.select("doc_key", "id", F.explode(F.sequence("start_block", "end_block")).alias("block"))
    return covered.groupBy("doc_key", "block").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def counted(items: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotations of each item, zero included."""
    n = notes.groupBy(F.col("doc_key").alias("id")).agg(F.count("*").alias("n"))
    return items.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("annotation_count"))


def upserted(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows after changes (id, color, note, gone): gone rows go, given values replace, new ids join. Of changes to one id the
    greatest (gone, color, note) counts; rows of one id all take it."""
    new = changes.toDF("id", "new_color", "new_note", "gone").groupBy("id").agg(F.max(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), "new_color", "new_note")).alias("c")).select("id", "c.*")
    both = notes.select("id", "color", "note").join(new, "id", "full_outer")
    return both.where("not coalesce(gone, false)").select("id", F.coalesce("new_color", "color").alias("color"), F.coalesce("new_note", "note").alias("note"), F.when(F.coalesce("new_note", "note").isNotNull(), "note").otherwise("highlight").alias("type"))


def with_items(notes: DataFrame, items: DataFrame) -> DataFrame:
    """Annotations with title and type of their item (key, title, type, last_opened, id); of items with one key the last
    opened wins, and annotations without an item stay."""
    new = F.struct("last_opened", "id")
    once = items.groupBy(F.col("key").alias("doc_key")).agg(F.max_by("title", new).alias("title"), F.max_by("type", new).alias("item_type"))
    return notes.join(once, "doc_key", "left").select("id", "doc_key", "title", "item_type")


def at_words(words: DataFrame, notes: DataFrame) -> DataFrame:
    """The first annotation over each word (doc_key, block, word), blocks between its ends included; the join is on document
    and block, with a range of words.  Notes with a column ``block`` have a row for each of their blocks already."""
    spread = notes if "block" in notes.columns else notes.withColumn("block", F.explode(F.sequence("start_block", "end_block")))
    first = F.when(F.col("block") == F.col("start_block"), F.col("start_word")).otherwise(F.lit(0))
    last = F.when(F.col("block") == F.col("end_block"), F.col("end_word"))
    ranges = spread.select("doc_key", "block", "id", "color", "start_block", "start_word", first.alias("first"), last.alias("last"))
    hit = words.join(ranges, ["doc_key", "block"]).where((F.col("word") >= F.col("first")) & (F.col("last").isNull() | (F.col("word") <= F.col("last"))))
    order = F.struct("start_block", "start_word", "id", "color")
    return hit.groupBy("doc_key", "block", "word").agg(F.min(order).alias("m"), F.count("*").alias("n")).select("doc_key", "block", "word", F.col("m.id").alias("id"), F.col("m.color").alias("color"), "n")


def import_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A10: of each document the annotations (doc_key, text) that a merging import adds, and those that it skips because the
    document, or an earlier row of the import, has the same text."""
    batch = incoming.groupBy("doc_key", "text").agg(F.count("*").alias("n"))
    known = existing.select("doc_key", "text", F.lit(1).alias("known")).distinct()
    j = batch.join(known, ["doc_key", "text"], "left")
    return j.groupBy("doc_key").agg(F.count_if(F.col("known").isNull()).alias("imported"), F.sum(F.when(F.col("known").isNull(), F.col("n") - 1).otherwise(F.col("n"))).alias("skipped"))


def exported_lines(notes: DataFrame) -> DataFrame:
    """One numbered Markdown line for each annotation of a document, in the order of positions."""
    number = F.row_number().over(_in_place(notes)).cast("string")
    mark = F.when(F.col("favorite"), F.lit(" *")).otherwise(F.lit(""))
    return notes.select("doc_key", "id", F.concat(number, F.lit(". **"), F.col("color"), F.lit("**"), mark, F.coalesce(F.concat(F.lit(": "), F.col("note")), F.lit(""))).alias("line"))


def escaped(text: Column) -> Column:
    """Text with the five signs of markup as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def quoted(text: Column) -> Column:
    """Text as a JSON string; null for null."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))  # the brackets of the array: inside them stand quotation marks, or null


def copied(note: Column | None = None) -> Column:
    """An annotation (text, note) as it is copied: the text in quotation marks, a note that is not blank below it (``note``, where it
    has been trimmed already)."""
    note = trimmed(F.coalesce("note", F.lit(""))) if note is None else note
    return F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"'), F.when(note != "", F.concat(F.lit("\nNote: "), note)).otherwise(""))


def exported(notes: DataFrame, kind: str, exported_at: str) -> DataFrame:
    """The files of documents in one of ``FORMATS``, as parts (doc_key, place, part): the head at place 0, one part for each annotation
    (id, text, note, color, favorite, tags, created, start_block, start_word; title of the document) in the order of positions, and what
    closes a file. A file is its parts by place, with line feeds between.  Parts stay rows, so a document with very many annotations is
    sorted and counted with spilling, never gathered into one value.  Missing titles are ``Untitled``; of several in a document the
    greatest holds."""
    return exported_files(notes, (kind,), exported_at).drop("format")


def exported_files(notes: DataFrame, kinds: tuple[str, ...], exported_at: str) -> DataFrame:
    """The parts of ``exported`` in several formats (format, doc_key, place, part); annotations are ordered and counted once for all."""
    whole = Window.partitionBy("doc_key")
    n = F.count("*").over(whole).alias("n")
    title = F.coalesce(F.max("title").over(whole), F.lit("Untitled"))
    own = notes.withColumns({"text": F.coalesce("text", F.lit("")), "noted": trimmed(F.coalesce("note", F.lit("")))})
    rows = own.select("*", F.row_number().over(_in_place(notes)).cast("long").alias("place"), n, title.alias("of"))
    last, found = F.col("place") == F.col("n"), []
    for kind in kinds:
        part = lambda place, text: F.struct(F.lit(kind).alias("format"), place.alias("place"), text.alias("part"))  # noqa: B023, E731
        head, entry, foot = _PARTS[kind](F.col("of"), F.col("n"), last, F.col("noted"), exported_at)
        found += [F.when(F.col("place") == 1, part(F.lit(0).cast("long"), head)), part(F.col("place"), entry)]
        if foot is not None:
            found.append(F.when(last, part(F.col("place") + 1, foot)))
    made = rows.select("doc_key", F.array(*found).alias("parts"))  # a step of its own: inside explode its expressions would be interpreted
    parts = made.select("doc_key", F.explode("parts").alias("p")).where("p is not null")
    return parts.select("p.format", "doc_key", "p.place", "p.part")


def _text(*parts) -> Column:
    """Strings and columns, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _markdown(title, n, last, note, exported_at):
    noted = F.when(note != "", _text("\n**Note:** ", note, "\n")).otherwise("")
    entry = _text("## Highlight ", F.col("place").cast("string"), '\n> "', F.col("text"), '"\n', noted, F.when(last, "").otherwise("\n---\n"))
    return _text('# Highlights from "', title, '"\n'), entry, None


def _plain(title, n, last, note, exported_at):
    return _text('Highlights from "', title, '"\n'), _text("---\n\n", copied(note), F.when(last, "").otherwise("\n")), None


def _json(title, n, last, note, exported_at):
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    listed = F.when(F.size(tags) == 0, "[]").otherwise(_text("[\n        ", F.array_join(F.transform(tags, quoted), ",\n        "), "\n      ]"))
    fields = {"text": quoted(F.col("text")), "note": quoted(F.when(F.col("note") != "", F.col("note"))), "color": quoted(F.col("color")), "isFavorite": F.coalesce("favorite", F.lit(False)).cast("string"), "tags": listed, "createdAt": F.coalesce(_text('"', F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '"'), F.lit("null"))}
    body = F.concat_ws(",\n", *(_text(f'      "{k}": ', v) for k, v in fields.items()))
    head = _text('{\n  "documentTitle": ', quoted(title), f',\n  "exportedAt": "{exported_at}T00:00:00.000Z",\n  "annotations": [')
    return head, _text("    {\n", body, F.when(last, "\n    }").otherwise("\n    },")), F.lit("  ]\n}")


def _html(title, n, last, note, exported_at):
    star = F.when(F.coalesce("favorite", F.lit(False)), "★").otherwise("")
    quote = _text('<blockquote style="border-left: 4px solid ', escaped(F.col("color")), '">"', escaped(F.col("text")), '"</blockquote>')
    entry = _text("<li>", star, quote, F.when(note != "", _text('<p class="note">', escaped(note), "</p>")).otherwise(""), "<small>", F.date_format("created", "MMMM d, yyyy"), "</small></li>")
    named = escaped(title)
    number = _text(n.cast("string"), F.when(n == 1, " highlight").otherwise(" highlights"))
    head = _text('<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Highlights from "', named, '"</title></head>\n<body><h1>Highlights from "', named, '"</h1>\n<p>', number, " · Exported ", F.date_format(F.lit(exported_at).cast("date"), "MMMM d, yyyy"), "</p>\n<ol>")
    return head, entry, F.lit("</ol></body></html>")


_PARTS = {"markdown": _markdown, "text": _plain, "html": _html, "json": _json}


def tag_suggestions(notes: DataFrame, typed: str, used: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """F8: the ``top`` most frequent tags that contain what is typed and are not used yet; the limit is the feature."""
    tags = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.where(F.lower("tag").contains(typed.lower()) & ~F.col("tag").isin(*used, "")).orderBy(F.desc("n"), "tag").limit(top)
