"""Reading statistics over streams of sessions and activity (user_id, ts, ...), with event time and watermarks.

The driver only steers: each batch of a stream is written as a Parquet folder of its number, so a batch that runs again after a
lost executor or a restart replaces its own rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share; where none is set, a temporary one in a session of one machine (tests) and
    an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Rows that a stream has given when all that is available has been read, with the number of their batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(f"{folder}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch that updated it."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in values))


def _windowed(sessions: DataFrame, *window: str) -> DataFrame:
    grouped = sessions.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", *window))
    return grouped.agg(F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.count("*").alias("sessions")).select("user_id", F.col("window.start").alias("start"), "time_ms", "words", "sessions")


def daily(sessions: DataFrame, folder: str) -> DataFrame:
    """Time, words and sessions of each user and day; rows over a day late are dropped, and the batch rollup repairs them."""
    return latest(written(_windowed(sessions, "1 day"), folder, "update"), "user_id", "start").withColumn("day", F.to_date("start")).drop("start")


def hourly(sessions: DataFrame, folder: str) -> DataFrame:
    """The same by hours."""
    return latest(written(_windowed(sessions, "1 hour"), folder, "update"), "user_id", "start")


def rolling_week(sessions: DataFrame, folder: str) -> DataFrame:
    """The same over seven days, from each day on."""
    return latest(written(_windowed(sessions, "7 days", "1 day"), folder, "update"), "user_id", "start").withColumn("day", F.to_date("start")).drop("start")


def sittings(activity: DataFrame, folder: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of activity of a user without a longer gap, given once the watermark has passed their end."""
    runs = activity.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return written(runs.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"), folder, "append").drop("batch")


def annotated_sessions(sessions: DataFrame, notes: DataFrame, folder: str, longest: str = "1 hour") -> DataFrame:
    """Annotations (user_id, ts, note_id) made while a session of the user was open; sessions last ``longest`` at most, which
    bounds the state of the join."""
    s = sessions.withWatermark("ts", LATE).select(F.col("user_id").alias("reader"), F.col("ts").alias("opened"), F.col("event_id").alias("session_id"), "duration_ms")
    n = notes.withWatermark("ts", LATE)
    inside = (F.col("reader") == F.col("user_id")) & (F.col("ts") >= F.col("opened")) & (F.col("ts") <= F.col("opened") + F.expr(f"interval {longest}"))
    open_ = F.unix_micros("ts") <= F.unix_micros("opened") + F.col("duration_ms") * 1000
    return written(s.join(n, inside).where(open_).select("user_id", "session_id", "note_id"), folder, "append").drop("batch")
