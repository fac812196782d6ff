"""Import, export and upkeep of library and statistics rows: defaults, validation, merges, backfill, upserts, files.

Everything is a projection, a group-by or a join on a user's key; nothing is collected. Edge cases: null and broken JSON is invalid,
not an error; missing sections count 0; repeated keys of an import count once, the latest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import round_half_up, trimmed
from lectern.operators.identity import normalised_url, stable_id, text_hash, type_of_source

#: File types by their endings, and the version of a statistics export.
FILE_TYPES = {"pdf": ("pdf",), "docx": ("docx",), "epub": ("epub",), "mobi": ("mobi", "azw", "azw3")}
STATS_VERSION = "1.0"
HEAVY = ("content", "paste_content")
PASTE_LIMIT = 100_000
STATS_SCHEMA = "version string, exportedAt string, lifetime struct<totalReadingTimeMs: bigint, totalWordsRead: bigint, totalDocumentsCompleted: bigint>, dailyStats array<string>, weeklyStats array<string>"
NOTES_SCHEMA = "documentTitle string, annotations array<struct<text: string, color: string, createdAt: string>>"


def snapshot(items: DataFrame) -> DataFrame:
    """A2: items with the defaults of what is missing."""
    return items.withColumns({"title": F.coalesce("title", F.lit("Untitled")), "author": F.coalesce("author", F.lit("")), "percent": F.coalesce("percent", F.lit(0)), "chapter": F.coalesce("chapter", F.lit(0)), "block": F.coalesce("block", F.lit(0))})


def light(items: DataFrame) -> DataFrame:
    """A3: items as replicas exchange them, without their heavy columns, which a scan then does not read."""
    return items.drop(*HEAVY)


def stats_import_report(files: DataFrame, json: str = "json") -> DataFrame:
    """Per file whether its statistics can be imported, why not, and what it holds."""
    x = F.from_json(json, STATS_SCHEMA, {"mode": "PERMISSIVE"})
    read = files.select(*(c for c in files.columns if c != json), x.alias("x"), (F.get_json_object(json, "$").isNotNull()).alias("parsed"), F.get_json_object(json, "$.lifetime").alias("lifetime"))
    error = F.when(~F.coalesce("parsed", F.lit(False)), "Invalid JSON file").when(F.col("x.version").isNull() | F.col("x.exportedAt").isNull() | F.col("lifetime").isNull(), "Invalid file format: missing required fields").when(F.col("x.version") != STATS_VERSION, F.concat(F.lit("Unsupported version: "), F.col("x.version")))
    counts = {"words": "x.lifetime.totalWordsRead", "documents": "x.lifetime.totalDocumentsCompleted"}
    keys = [c for c in files.columns if c != json]
    out = read.select(*keys, error.alias("error"), *(F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in counts.items()), *(F.coalesce(F.size(f"x.{c}"), F.lit(0)).cast("long").alias(n) for n, c in (("days", "dailyStats"), ("weeks", "weeklyStats"))))
    return out.select(*keys, F.col("error").isNull().alias("valid"), "error", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("words", "documents", "days", "weeks")))


def imported_rows(existing: DataFrame, imported: DataFrame, *keys: str) -> DataFrame:
    """Days, weeks and speeds: what exists stays, and what only the import has is added."""
    return existing.unionByName(imported.join(existing.select(*keys), list(keys), "left_anti"))


def imported_hours(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Hours of the day are added up, as they stand for different times."""
    return existing.unionByName(imported).groupBy("user_id", "hour").agg(F.sum("time_ms").alias("time_ms"), F.sum("sessions").alias("sessions"))


def greatest_totals(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of each key the greatest of each total."""
    return rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in values))


def imported_stats(existing: dict[str, DataFrame], imported: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Statistics after an import, by section, of the sections that both have: the greatest totals; days, weeks and speeds of
    the import where there are none; hours added up; the better bests, what exists on ties; goals where there are none."""
    from lectern.operators.merge import better_bests

    two = lambda name: existing[name].withColumn("replica", F.lit(0)).unionByName(imported[name].withColumn("replica", F.lit(1)))
    rules = {
        "totals": lambda: greatest_totals(two("totals").drop("replica"), ["user_id"], [c for c in existing["totals"].columns if c != "user_id"]), "days": lambda: imported_rows(existing["days"], imported["days"], "user_id", "day"),
        "weeks": lambda: imported_rows(existing["weeks"], imported["weeks"], "user_id", "week"), "wpm": lambda: imported_rows(existing["wpm"], imported["wpm"], "user_id", "day"), "hours": lambda: imported_hours(existing["hours"], imported["hours"]),
        "bests": lambda: better_bests(two("bests")), "goals": lambda: imported_rows(existing["goals"], imported["goals"], "user_id"),
    }
    return {name: rule() for name, rule in rules.items() if name in existing and name in imported}


def notes_import_report(files: DataFrame, json: str = "json") -> DataFrame:
    """Per file whether it can be imported (a title, and text, color and time of each annotation), and its annotations."""
    x = F.from_json(json, NOTES_SCHEMA)
    read = files.select(*(c for c in files.columns if c != json), x.alias("x"))
    whole = F.forall("x.annotations", lambda a: a["text"].isNotNull() & a["color"].isNotNull() & a["createdAt"].isNotNull())
    valid = F.coalesce(F.col("x.documentTitle").isNotNull() & F.col("x.annotations").isNotNull() & whole, F.lit(False))
    return read.select(*(c for c in files.columns if c != json), valid.alias("valid"), F.when(valid, F.size("x.annotations")).cast("long").alias("annotations"))


def backfilled(recents: DataFrame, device: Column) -> DataFrame:
    """Recent documents (id, source, title, url, file_name, file_hash, opened) of the first schema as archive rows of the third."""
    label = F.coalesce(F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.col("url")), F.col("file_name"), F.col("source"))
    return recents.select("id", type_of_source(F.col("source")).alias("type"), "title", label.alias("source_label"), "url", F.col("opened").alias("created"), F.col("opened").alias("last_opened"), "file_hash", device.alias("device_id"), F.lit(False).alias("sync_enabled"), F.lit(None).cast("string").alias("sync_provider"), F.lit(None).cast("timestamp_ntz").alias("last_sync"))


def file_type(name: Column) -> Column:
    """Type of a file by its ending, behind which a browser may have put .zip; null where it is not supported."""
    bare = F.regexp_replace(F.lower(name), r"\.zip$", "")
    out = F.lit(None).cast("string")
    for kind, endings in FILE_TYPES.items():
        for ending in endings:
            out = F.when(bare.endswith(f".{ending}"), kind).otherwise(out)
    return out


def split_paragraph(text: Column) -> Column:
    """A paragraph of over 1000 characters as paragraphs that end with the sentence that takes them over 500."""
    sentences = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")

    def step(state: Column, sentence: Column) -> Column:
        own = F.concat(state["own"], sentence, F.lit(" "))
        full = F.length(own) > 500
        return F.struct(F.when(full, F.concat(state["out"], F.array(trimmed(own)))).otherwise(state["out"]).alias("out"), F.when(full, "").otherwise(own).alias("own"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("own"))
    folded = F.aggregate(sentences, start, step, lambda s: F.when(trimmed(s["own"]) != "", F.concat(s["out"], F.array(trimmed(s["own"])))).otherwise(s["out"]))
    return F.when(F.length(text) > 1000, folded).otherwise(F.array(text))


_ITEM = ("title", "author", "type", "url", "file_hash", "word_count", "paste_content")


def _keys(items: DataFrame, pasted: Column) -> DataFrame:
    """Adds hash_key (of the file, else of the pasted text where ``pasted`` says so) and url_key; paste_content is null where it is missing."""
    own = F.col("file_hash")
    if "paste_content" in items.columns:
        own = F.coalesce(own, F.when(pasted & (F.col("paste_content") != ""), text_hash(F.col("paste_content"))))
    else:
        items = items.withColumn("paste_content", F.lit(None).cast("string"))
    # exploded, as the plan would else repeat the rules of a URL wherever the key is used
    keys = F.struct(F.concat(F.lit("hash:"), own).alias("hash_key"), F.concat(F.lit("url:"), normalised_url(F.col("url"))).alias("url_key"))
    return items.withColumn("keys", F.explode(F.array(keys))).select(*items.columns, "keys.*")


def upserted(existing: DataFrame, inputs: DataFrame, now: Column | None = None, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Opened items (user_id, title, author, type, url, file_hash, word_count, opened; paste_content if there is any) laid over those of
    a library that have their file hash, that of their pasted text, or their URL; others are new.  An item keeps id and creation, and what
    an input leaves open; of several items that fit, the last opened one is taken, and of several inputs for one item the latest counts.
    Opened is ``now``, else the input's own time.  Pasted texts are cut to ``PASTE_LIMIT`` characters after they are hashed.  Inputs
    without hash, text and URL have no identity and are left out.  ``hold`` gets the frames that are read twice, with a name, and may
    give them back as tables.

    A key is one user's, so no user's items meet another's; keys are exploded and joined, never compared pair by pair."""
    pasted = "paste_content" in existing.columns or "paste_content" in inputs.columns
    # The latest input is the greatest of its fields; they end with its keys, which follow from the others.
    fields = F.struct("opened", "title", *(c for c in _ITEM if c != "title"), "hash_key", "url_key")
    keyed = _keys(inputs, F.col("file_hash").isNull()).withColumn("group", F.coalesce("hash_key", "url_key")).where("group is not null")

    def latest(rows: DataFrame, keys: Column) -> DataFrame:
        return rows.groupBy("user_id", "group").agg(F.max(fields).alias("b"), keys.alias("keys")).select("user_id", "group", "b.*", "keys")

    one = latest(keyed, F.concat(F.collect_set("hash_key"), F.collect_set("url_key"))).withColumn("group", F.coalesce("url_key", "group"))
    new = hold(latest(one, F.array_distinct(F.flatten(F.collect_set("keys")))).withColumn("paste_content", F.substring("paste_content", 1, PASTE_LIMIT)), "inputs")

    own = _keys(existing, (F.col("type") == "paste") & F.col("file_hash").isNull())
    held = own.select("user_id", "id", "last_opened", F.explode(F.filter(F.array("hash_key", "url_key"), lambda k: k.isNotNull())).alias("key"))
    hits = new.select("user_id", "group", "opened", F.explode("keys").alias("key")).join(held, ["user_id", "key"])
    first = Window.partitionBy("user_id", "group").orderBy(F.desc("last_opened"), "id")
    taken = hits.withColumn("n", F.row_number().over(first)).where("n = 1").select("user_id", "group", F.col("id").alias("item"))

    matched = hold(new.join(taken, ["user_id", "group"], "left"), "matched")
    last = Window.partitionBy("user_id", "item").orderBy(F.desc("opened"), F.desc("title"), "group")
    over = matched.where("item is not null").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    a, b = own.alias("a"), over.alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.id") == F.col("b.item")), "left")
    opened = F.col("b.opened") if now is None else F.when(F.col("b.group").isNotNull(), now)
    given = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    hashed = F.coalesce("b.file_hash", "a.file_hash", F.when(F.col("b.paste_content").isNotNull(), F.regexp_replace("b.hash_key", "^hash:", ""))).alias("file_hash")
    laid = both.select("a.user_id", F.col("a.id").cast("string").alias("id"), *(hashed if c == "file_hash" else given(c) for c in _ITEM), F.col("a.created").alias("created"), F.coalesce(opened, F.col("a.last_opened")).alias("last_opened"))
    at = F.col("opened") if now is None else now
    fresh = matched.where("item is null").select("user_id", stable_id(F.col("type"), F.col("file_hash"), F.col("url"), F.col("paste_content") if pasted else F.lit(None).cast("string")).alias("id"), *_ITEM, at.alias("created"), at.alias("last_opened"))
    out = laid.unionByName(fresh)
    return out if pasted else out.drop("paste_content")


def looked_up(items: DataFrame, ids: DataFrame) -> DataFrame:
    """H4: the items with these ids (id)."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def large_number(n: Column) -> Column:
    """Thousands as K and millions as M with one decimal, halves up."""
    tenths = lambda unit: F.floor((n * 10 + unit // 2) / unit).cast("long")
    shown = lambda unit, mark: F.concat(F.floor(tenths(unit) / 10).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(mark))
    return F.when(n >= 1_000_000, shown(1_000_000, "M")).when(n >= 1000, shown(1000, "K")).otherwise(n.cast("string"))


def relative_time(seconds: Column, then: Column, now: Column) -> Column:
    """How long ago a time lies that is ``seconds`` before ``now``; from a week on its day, with the year where it is another."""
    count = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(seconds / k).cast("long") for k in (60, 3600, 86_400))
    date = F.concat(F.date_format(then, "MMM d"), F.when(F.year(then) != F.year(now), F.date_format(then, ", yyyy")).otherwise(""))
    return F.when(seconds < 60, "Just now").when(minutes < 60, count(minutes, "minute")).when(hours < 24, count(hours, "hour")).when(days == 1, "Yesterday").when(days < 7, count(days, "day")).otherwise(date)


def overwritten(local: DataFrame, remote: DataFrame, *keys: str) -> DataFrame:
    """Remote rows, and the local rows whose keys they lack."""
    return remote.unionByName(local.join(remote.select(*keys), list(keys), "left_anti").select(*remote.columns))


def merged_weeks(weeks: DataFrame) -> DataFrame:
    """Weeks (replica, user_id, week, ...) of all replicas: the greatest of each value, and the mean of their speeds."""
    greatest = ("time_ms", "words", "completed", "sessions", "active_days")
    return weeks.groupBy("user_id", "week").agg(*(F.max(c).alias(c) for c in greatest), round_half_up(F.sum("avg_wpm") / F.count("avg_wpm")).alias("avg_wpm"))


def sync_outcome(heads: DataFrame) -> DataFrame:
    """What a sync of each replica (local and remote stamp, same_device, has_changes) has come to."""
    same = F.col("same_device") & (F.col("local") == F.col("remote"))
    action = F.when(F.col("remote").isNull(), "uploaded").when(same, "no-change").when(F.col("has_changes"), "merged").when(F.col("remote") > F.col("local"), "downloaded").otherwise("uploaded")
    return heads.select("id", action.alias("action"))


#: O1: SQL functions, by name: parameters, type and expression.
SQL_FUNCTIONS = {
    "reading_words": ("t string", "bigint", "size(filter(split(coalesce(t, ''), '\\\\s+'), w -> w <> ''))"),
    "reading_duration": ("ms bigint", "string", "case when ms < 3600000 then concat(ms div 60000, 'm') when ms div 60000 % 60 = 0 then concat(ms div 3600000, 'h') else concat(ms div 3600000, 'h ', ms div 60000 % 60, 'm') end"),
    "reading_minutes": ("words bigint, wpm int", "double", "words / cast(wpm as double)"),
}


def register(spark) -> None:
    """O1: make the SQL functions known to a session."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")


#: Bytes of each end of a file that count for its fingerprint; a file of up to twice as many counts whole.
SAMPLE = 64 * 1024
#: Bytes of a file above which only its ends are read.
LARGE = 16 << 20


def fingerprint(content: Column, length: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a file of up to twice ``SAMPLE`` bytes, else of its two ends and its size
    in eight bytes, the lowest first."""
    size = F.unhex(F.concat(*(F.substring(F.lpad(F.hex(length), 16, "0"), k, 2) for k in range(15, 0, -2))))
    ends = F.concat(F.substring(content, 1, SAMPLE), F.substring(content, -SAMPLE, SAMPLE), size)
    return F.substring(F.sha2(F.when(length <= 2 * SAMPLE, content).otherwise(ends), 256), 1, 16)


def _ends(spark, path: str, length: int) -> bytes:
    """The two ends of a large file, of any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        read = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        head = read(file, SAMPLE)
        file.seek(length - SAMPLE)
        return head + read(file, SAMPLE)
    finally:
        file.close()


def file_fingerprints(spark, folder: str, pattern: str = "*") -> DataFrame:
    """Path, length and fingerprint of the files of a folder, whatever their kind. A file of up to ``LARGE`` bytes is read as one row;
    of a larger one, of any size, only the two ends are read (128 KB, by the driver) and nothing else. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= LARGE).select("path", "length", fingerprint(F.col("content"), F.col("length")).alias("file_hash"))
    large = files.where(F.col("length") > LARGE).select("path", "length").collect()
    hashed = [(r.path, r.length, hashlib.sha256(_ends(spark, r.path, r.length) + r.length.to_bytes(8, "little")).hexdigest()[:16]) for r in large]
    return small.unionByName(spark.createDataFrame(hashed, small.schema)) if hashed else small
