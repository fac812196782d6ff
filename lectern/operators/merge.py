"""Merging copies of a library that several devices hold: rows of all replicas together, with a replica number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.identity import COLUMNS, deduplicated, merged, normalised_url


def further_positions(positions: DataFrame, *keys: str) -> DataFrame:
    """M1, M8: of each key the position read furthest: chapter (none is 0), then block, then time."""
    far = F.struct(F.coalesce(F.col("chapter"), F.lit(0)), F.col("block"), F.col("last_opened"), -F.col("replica"))
    return positions.groupBy(*keys).agg(*(F.max_by(c, far).alias(c) for c in ("chapter", "block", "last_opened")))


def further_progress(positions: DataFrame, *keys: str) -> DataFrame:
    """M2: of each key the highest progress, the first replica on ties."""
    return positions.groupBy(*keys).agg(F.max("percent").alias("percent"), F.max_by("replica", F.struct("percent", -F.col("replica"))).alias("replica"))


def merged_tombstones(stones: DataFrame) -> DataFrame:
    """M5: the newest deletion of each key."""
    return stones.groupBy("user_id", "key").agg(F.max("deleted_at").alias("deleted_at"))


def not_deleted(items: DataFrame, stones: DataFrame, respect_time: bool = False) -> DataFrame:
    """M6: items without a tombstone of their id, hash or url; with ``respect_time`` only one as late as the item's creation."""
    keys = F.array(F.col("id").cast("string"), F.concat(F.lit("hash:"), F.col("file_hash")), F.concat(F.lit("url:"), normalised_url(F.col("url"))))
    keyed = items.select("user_id", "id", "created", F.explode(keys).alias("key")).where("key is not null")
    hit = keyed.join(stones, ["user_id", "key"])
    hit = hit.where("deleted_at >= created") if respect_time else hit
    return items.join(hit.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti")


def merged_library(replicas: DataFrame, stones: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """M7: merge by hash, by url and by id, then take away what is deleted.  The merged rows are read twice, for their keys and whole; ``hold``
    gets them and may give them back as a table."""
    once = deduplicated(replicas).drop("merged_rows")
    by_id = merged(once, "user_id", "id_key") if "id_key" in once.columns else merged(once.withColumn("id_key", F.col("id")), "user_id", "id_key")
    return not_deleted(hold(by_id.select(*COLUMNS)), stones)


def newest_rows(rows: DataFrame, keys: list[str], stamp: str, priority: str = "replica") -> DataFrame:
    """Of each key the row with the newest stamp, the higher replica on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(stamp), F.desc(priority))
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def conflicts(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that both have with other values, and which values differ."""
    differ = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in values]
    joined = a.alias("a").join(b.alias("b"), keys).select(*keys, F.concat_ws(",", *differ).alias("fields"))
    return joined.where("fields <> ''")


def content_plan(content: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to upload (content without an entry), to download (entry without content), or keep."""
    both = content.select("id", F.lit(True).alias("here")).join(manifest.select("id", F.lit(True).alias("there")), "id", "full_outer")
    return both.select("id", F.when(F.col("there").isNull(), "upload").when(F.col("here").isNull(), "download").otherwise("keep").alias("action"))


def merged_membership(pairs: DataFrame) -> DataFrame:
    """M3: collections of pairs (id, a, a_stamp, b, b_stamp): of the newer stamp, a on ties; one stamp alone wins; without stamps
    both together. An empty list is null."""
    a, b = F.col("a_stamp"), F.col("b_stamp")
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("a", none), F.coalesce("b", none))
    chosen = F.when(a.isNotNull() & (b.isNull() | (a >= b)), F.col("a")).when(b.isNotNull(), F.col("b")).otherwise(both)
    out = pairs.select("id", F.array_sort(chosen).alias("ids"), F.greatest(a, b).alias("stamp"))
    return out.select("id", F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("collections"), "stamp")


def merged_daily(sessions: DataFrame) -> DataFrame:
    """Days of all replicas (sessions with a replica number): the greatest time and words of any replica, and the documents
    of all together."""
    own = sessions.groupBy("replica", "user_id", "day").agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"))
    most = own.groupBy("user_id", "day").agg(F.max("time_ms").alias("time_ms"), F.max("words").alias("words"))
    documents = sessions.groupBy("user_id", "day").agg(F.count_distinct("document_id").alias("opened"), F.count_distinct(F.when(F.col("completed"), F.col("document_id"))).alias("completed"))
    return most.join(documents, ["user_id", "day"])


def merged_hours(sessions: DataFrame) -> DataFrame:
    """Hours of all replicas: the greatest time and sessions of any replica; hours without either are left out."""
    own = sessions.groupBy("replica", "user_id", F.hour("ts").cast("long").alias("hour")).agg(F.sum("duration_ms").alias("time_ms"), F.count("*").alias("sessions"))
    return own.groupBy("user_id", "hour").agg(F.max("time_ms").alias("time_ms"), F.max("sessions").alias("sessions"))


def merged_wpm(history: DataFrame) -> DataFrame:
    """Speed of each day from the replica with more sessions, the lower replica on ties."""
    more = F.struct("sessions", -F.col("replica"))
    return history.groupBy("user_id", "day").agg(F.max_by("avg_wpm", more).alias("avg_wpm"), F.max("sessions").alias("sessions"))


def better_bests(bests: DataFrame) -> DataFrame:
    """The better of the replicas' personal bests with its day, the lower replica on ties."""
    by = lambda value, day: (F.max(value).alias(value), F.max_by(day, F.when(F.col(value).isNotNull(), F.struct(value, -F.col("replica")))).alias(day))
    return bests.groupBy("user_id").agg(*by("longest_ms", "longest_day"), *by("fastest_wpm", "fastest_day"), *by("most_words", "most_words_day"))


def applied(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows with the local cached content (column content), and the rows that only the local side has."""
    kept = remote.drop("content").join(local.select("id", "content"), "id", "left")
    return kept.unionByName(local.join(remote.select("id"), "id", "left_anti").select(*kept.columns))
