"""Reading statistics as files: JSON with a row for each user, and CSV with a table for each section; both can be read back.

Sections of a user are bounded (90 days, 104 weeks, 90 speeds, 24 hours), so a user's row is small however long they have read.

Edge cases: users with annotations alone have days, but no speeds, hours, bests or weeks; users without goals have null goals; titles and
other text with quotes, commas and line feeds come back as they were, and so do empty texts; in CSV a null is
``\\N``, so a text that reads so comes back as null; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import stats as K
from lectern.operators.exchange import STATS_VERSION

#: The columns of each section of an export, as files name them, and the columns that they are made of.
DAILY = {"Date": "day", "Reading Time": "reading_time", "Reading Time (ms)": "time_ms", "Words Read": "words", "Docs Opened": "opened", "Docs Completed": "completed", "Annotations": "annotations"}
WEEKLY = {"Week Start": "week", "Reading Time": "reading_time", "Reading Time (ms)": "time_ms", "Words Read": "words", "Docs Completed": "completed", "Annotations": "annotations", "Avg WPM": "avg_wpm", "Sessions": "sessions", "Active Days": "active_days"}
WPM = {"Date": "day", "Average WPM": "avg_wpm", "Session Count": "sessions"}
HOURLY = {"Hour": "hour", "Total Reading Time (ms)": "time_ms", "Session Count": "sessions"}
LIFETIME = {"Total Reading Time": "reading_time", "Total Reading Time (ms)": "time_ms", "Total Words Read": "words", "Documents Completed": "completed", "Annotations Created": "annotations", "Current Streak": "current_streak", "Longest Streak": "longest_streak", "Last Reading Date": "last_day"}
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N"}


def reading_time(ms: Column) -> Column:
    """``Xh Ym``, or ``Ym`` under an hour, of whole minutes."""
    return K.duration_label(ms)


def weekly_sections(sessions: DataFrame, annotations: DataFrame, as_of: str) -> DataFrame:
    """K7 with the documents completed, a document once a day, and the annotations of each week."""
    old = F.col("day") < F.date_sub(F.lit(as_of).cast("date"), K.KEEP_DAYS)
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    done = sessions.where(old & F.col("completed")).select("user_id", "day", "document_id").distinct().groupBy("user_id", week).agg(F.count("*").alias("completed"))
    noted = annotations.where(old).groupBy("user_id", week).agg(F.count("*").alias("annotations"))
    rows = K.weekly_rollup(sessions, as_of).join(done, ["user_id", "week"], "left").join(noted, ["user_id", "week"], "left")
    return K.retained(rows.na.fill(0, ["completed", "annotations"]), "week", as_of, 7 * K.KEEP_WEEKS)


def sections(sessions: DataFrame, annotations: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The sections of an export by name: lifetime, bests, daily, weekly, wpm, hourly; each with user_id and its columns' own names."""
    days = K.daily_rollup(sessions, annotations)
    lifetime = K.lifetime_totals(days).join(K.streaks(days.where("sessions > 0")), "user_id", "left").na.fill(0, ["current_streak", "longest_streak"])
    timed = lambda df: df.withColumn("reading_time", reading_time(F.col("time_ms")))
    return {
        "lifetime": timed(lifetime).select("user_id", *LIFETIME.values()), "bests": K.personal_bests(sessions), "daily": timed(K.retained(days, "day", as_of, K.KEEP_DAYS)).select("user_id", *DAILY.values()),
        "weekly": timed(weekly_sections(sessions, annotations, as_of)).select("user_id", *WEEKLY.values()), "wpm": K.wpm_history(sessions).select("user_id", *WPM.values()), "hourly": K.hourly_activity(sessions).select("user_id", *HOURLY.values()),
    }


def _gathered(rows: DataFrame, name: str, **fields: str | Column) -> DataFrame:
    """(user_id, name): the rows of each user as structs, in the order of their first field."""
    one = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias(name))


def stats_export(sessions: DataFrame, annotations: DataFrame, goals: DataFrame, as_of: str, exported_at: str) -> DataFrame:
    """A4: a row for each user with the seven sections of an export, days and weeks in order of their dates."""
    s = sections(sessions, annotations, as_of)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    lifetime = F.struct(
        F.col("time_ms").alias("totalReadingTimeMs"), F.col("reading_time").alias("totalReadingTimeFormatted"), F.col("words").alias("totalWordsRead"), F.col("completed").alias("totalDocumentsCompleted"), F.col("annotations").alias("totalAnnotationsCreated"),
        F.col("current_streak").alias("currentStreak"), F.col("longest_streak").alias("longestStreak"), text("last_day").alias("lastReadingDate"),
    )
    best = lambda value, day, name, *more: F.when(F.col(value).isNotNull(), F.struct(text(day).alias("date"), F.col(value).alias(name), *more))
    bests = F.struct(
        best("longest_ms", "longest_day", "durationMs", reading_time(F.col("longest_ms")).alias("durationFormatted")).alias("longestSession"), best("most_words", "most_words_day", "words").alias("mostWordsInDay"), best("fastest_wpm", "fastest_day", "wpm").alias("fastestWpm"),
    )
    parts = [
        _gathered(s["daily"], "dailyStats", date=text("day"), readingTimeMs="time_ms", readingTimeFormatted="reading_time", wordsRead="words", documentsOpened="opened", documentsCompleted="completed", annotationsCreated="annotations"),
        _gathered(s["weekly"], "weeklyStats", weekStart=text("week"), readingTimeMs="time_ms", readingTimeFormatted="reading_time", wordsRead="words", documentsCompleted="completed", annotationsCreated="annotations", avgWpm="avg_wpm", sessionCount="sessions", activeDays="active_days"),
        _gathered(s["wpm"], "wpmHistory", date=text("day"), avgWpm="avg_wpm", sessionCount="sessions"), _gathered(s["hourly"], "hourlyActivity", hour="hour", totalReadingTimeMs="time_ms", sessionCount="sessions"),
        s["bests"].select("user_id", bests.alias("personalBests")), goals.select("user_id", F.struct(F.col("daily_minutes").alias("dailyMinutes"), F.col("weekly_minutes").alias("weeklyMinutes"), F.col("monthly_documents").alias("monthlyDocuments")).alias("goals")),
    ]
    out = s["lifetime"].select(F.col("user_id"), F.lit(exported_at).alias("exportedAt"), F.lit(STATS_VERSION).alias("version"), lifetime.alias("lifetime"))
    for part in parts:
        out = out.join(part, "user_id", "left")
    lists = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("dailyStats", "weeklyStats", "wpmHistory", "hourlyActivity")}
    return out.withColumns(lists)


def write_json(export: DataFrame, path: str, buckets: int = 64) -> None:
    """A4: a JSON object a line, in folders by a hash of the user."""
    dealt = export.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.partitionBy("bucket").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, json) of the files that ``write_json`` wrote."""
    return spark.read.text(path).select(F.get_json_object("value", "$.user_id").cast("long").alias("user_id"), F.col("value").alias("json"))


def write_csv(rows: dict[str, DataFrame], folder: str) -> None:
    """A5: each section as CSV files with its header in a folder of its name; quoted where a value asks for it."""
    for name, df in rows.items():
        named = {"daily": DAILY, "weekly": WEEKLY, "wpm": WPM, "hourly": HOURLY, "lifetime": LIFETIME}.get(name, {c: c for c in df.columns if c != "user_id"})
        df.select(F.col("user_id").alias("User"), *(F.col(c).alias(k) for k, c in named.items())).write.options(**CSV).csv(f"{folder}/{name}")


def read_csv(spark: SparkSession, folder: str, name: str, like: DataFrame) -> DataFrame:
    """A section as ``write_csv`` was given it, with the columns and types of ``like``."""
    return spark.read.options(**CSV).schema(like.schema).csv(f"{folder}/{name}")
