"""Identity of documents: URL normalisation, keys, labels and library deduplication."""

from __future__ import annotations

import sys
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that do not identify a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


def normalised_url(url: Column) -> Column:
    """G1: lower-case host without www., no trailing slashes, tracking parameters or fragment, parameters in order; a url that
    cannot be parsed in lower case."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    parts = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"^[^/]*//([^/?#]*)", 1)
    user, port = F.regexp_extract(parts[1], r"^(.*@)", 1), F.regexp_extract(parts[1], r"(:[0-9]+)$", 1)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    # Order by name alone, as pairs of equal names keep their order.
    ordered = F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("name"), i.alias("place"), p.alias("pair")))), lambda s: s["pair"])
    query = F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise("")
    whole = F.concat(F.lower(parts[0]), F.lit("://"), user, host, port, F.when(path == "", "/").otherwise(path), query)
    return F.when(host.isNotNull() & (parts[0] != ""), whole).otherwise(F.lower(url))


def source_label(url: Column, file_name: Column, source: Column) -> Column:
    """Host without www., else the file name, else the source."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url, file_name, source)


def type_of_source(source: Column) -> Column:
    """The item type of a source."""
    return F.when(source.isin("pdf", "docx", "epub", "mobi", "paste"), source).otherwise("web")


def document_key(file_hash: Column, url: Column, title: Column, created: Column) -> Column:
    """Key of a document by file hash, else URL, else title and time."""
    return F.coalesce(F.concat(F.lit("hash:"), file_hash), F.concat(F.lit("url:"), normalised_url(url)), F.concat(F.lit("doc:"), title, F.lit("-"), created.cast("string")))


FURTHER = ("chapter", "block", "percent")


def merged(items: DataFrame, *keys: str) -> DataFrame:
    """M4: one row for each key: id, position and progress of the item read furthest, metadata of the item opened last, the
    earliest creation, and any hash and url. Ties go to the smaller id."""
    far = F.struct(F.coalesce(F.col("chapter"), F.lit(0)), F.col("block"), F.col("percent"), -F.col("id"))
    new = F.struct(F.col("last_opened"), -F.col("id"))
    return items.groupBy(*keys).agg(
        *(F.max_by(c, far).alias(c) for c in ("id", "chapter", "block", "percent")), *(F.max_by(c, new).alias(c) for c in ("title", "author", "type", "source_label", "word_count")), F.max("last_opened").alias("last_opened"), F.min("created").alias("created"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in ("file_hash", "url") if c not in keys), F.count("*").alias("merged_rows"),
    )


COLUMNS = ("user_id", "id", "title", "author", "type", "source_label", "created", "last_opened", "percent", "chapter", "block", "word_count", "file_hash", "url")


def deduplicated(items: DataFrame) -> DataFrame:
    """Merge a user's rows of one file hash, then those of one normalised URL, and pass the rest."""
    key = F.coalesce(F.concat(F.lit("hash:"), "file_hash"), F.concat(F.lit("url:"), normalised_url(F.col("url"))))
    keyed = items.withColumn("merge_key", key)
    once = merged(keyed.where("merge_key is not null"), "user_id", "merge_key").select(*COLUMNS, "merged_rows")
    return once.unionByName(keyed.where("merge_key is null").select(*COLUMNS, F.lit(1).cast("long").alias("merged_rows")))


def duplicates_removed(items: DataFrame) -> DataFrame:
    """Rows that deduplication takes away, for each user."""
    return deduplicated(items).groupBy("user_id").agg(F.sum(F.col("merged_rows") - 1).alias("removed"))


def _units(text: str) -> array:
    """UTF-16 units of a text, of which a code point beyond the first plane has two."""
    units = array("H", text.encode("utf-16-le", "surrogatepass"))
    if sys.byteorder == "big":
        units.byteswap()
    return units


def _magnitude(h: int) -> int:
    """A 32-bit number, taken as signed, without its sign."""
    return h if h < 1 << 31 else (1 << 32) - h


def _base36(n: int) -> str:
    digits = ""
    while n >= 36:
        n, rest = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[rest] + digits
    return "0123456789abcdefghijklmnopqrstuvwxyz"[n] + digits


def _hash31(text: str) -> str:
    h = 0
    for c in _units(text):
        h = (h * 31 + c) & 0xFFFFFFFF
    return _base36(_magnitude(h))


def _hash33(text: str) -> str:
    one, two = 5381, 52711
    for c in _units(text):
        one, two = (one * 33 & 0xFFFFFFFF) ^ c, (two * 33 & 0xFFFFFFFF) ^ c
    return format(_magnitude(one) * 4096 + _magnitude(two), "016x")


@F.pandas_udf(T.StringType())
def _string_hash(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _hash31(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _text_hash(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _hash33(t) for t in texts], dtype=object)


def string_hash(text: Column) -> Column:
    """32-bit hash by factors of 31 over UTF-16 units, without sign, in base 36; null of null. In Arrow batches, as each unit's step
    needs the one before."""
    return _string_hash(text)


def text_hash(text: Column) -> Column:
    """Two 32-bit hashes by factors of 33 and exclusive or over UTF-16 units, together as 16 hexadecimal digits; null of null. In Arrow
    batches."""
    return _text_hash(text)


def stable_id(type_: Column, file_hash: Column, url: Column, pasted: Column) -> Column:
    """Id of an item by its file, else its URL, else its pasted text."""
    return F.coalesce(F.concat(F.lit("file_"), type_, F.lit("_"), file_hash), F.concat(F.lit("web_"), string_hash(normalised_url(url))), F.concat(F.lit("paste_"), text_hash(pasted)))
