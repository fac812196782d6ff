"""Reading statistics over sessions (user_id, ts, day, duration_ms, document_id, completed, wpm, words).

Each operator groups by user, so partial sums are combined before the shuffle, and every window is one user's days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import ratio, round_half_up

KEEP_DAYS, KEEP_WEEKS, KEEP_WPM, FAST_MS = 90, 104, 90, 60_000


def daily_rollup(sessions: DataFrame, annotations: DataFrame) -> DataFrame:
    """K1: a row for each user and day with a session or an annotation."""
    read = sessions.groupBy("user_id", "day").agg(
        F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.count("*").alias("sessions"),
        F.count_distinct("document_id").alias("opened"), F.count_distinct(F.when(F.col("completed"), F.col("document_id"))).alias("completed"),
    )
    noted = annotation_activity(annotations)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return read.join(noted, ["user_id", "day"], "full_outer").select("user_id", "day", *map(zero, ("time_ms", "words", "sessions", "opened", "completed", "annotations")))


def annotation_activity(annotations: DataFrame) -> DataFrame:
    """Annotations of each user and day."""
    return annotations.groupBy("user_id", "day").agg(F.count("*").alias("annotations"))


def lifetime_totals(daily: DataFrame) -> DataFrame:
    """K2: totals of each user; completed counts a document once a day."""
    sums = (F.sum(c).alias(c) for c in ("time_ms", "words", "sessions", "completed", "annotations"))
    return daily.groupBy("user_id").agg(*sums, F.count_if(F.col("time_ms") > 0).alias("active_days"))


def streaks(daily: DataFrame) -> DataFrame:
    """K3: last run of consecutive days with activity, longest run, last day."""
    order = Window.partitionBy("user_id").orderBy("day")
    runs = daily.select("user_id", "day", F.date_sub("day", F.row_number().over(order)).alias("run")).groupBy("user_id", "run").agg(F.count("*").alias("days"), F.max("day").alias("last"))
    return runs.groupBy("user_id").agg(F.max_by("days", "last").alias("current_streak"), F.max("days").alias("longest_streak"), F.max("last").alias("last_day"))


def wpm_history(sessions: DataFrame, keep: int = KEEP_WPM) -> DataFrame:
    """K4: mean speed and sessions of each day, the newest ``keep`` days of each user."""
    days = sessions.where("wpm > 0").groupBy("user_id", "day").agg(round_half_up(F.sum("wpm") / F.count("*")).alias("avg_wpm"), F.count("*").alias("sessions"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("day"))
    return days.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep).drop("n")


def hourly_activity(sessions: DataFrame) -> DataFrame:
    """K5: time and sessions of each hour, 24 rows for each user."""
    found = sessions.groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(F.sum("duration_ms").alias("time_ms"), F.count("*").alias("sessions"))
    spine = sessions.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    return spine.join(found, ["user_id", "hour"], "left").select("user_id", "hour", F.coalesce("time_ms", F.lit(0)).alias("time_ms"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


def best_hour(hourly: DataFrame) -> DataFrame:
    """K5: the hour with most time, the earliest on ties."""
    return hourly.groupBy("user_id").agg(F.max_by("hour", F.struct("time_ms", -F.col("hour"))).alias("best_hour"), F.max("time_ms").alias("time_ms"))


def personal_bests(sessions: DataFrame) -> DataFrame:
    """K6: longest session, most words in a day, highest speed of sessions of a minute or more; the earliest on ties."""
    early = -F.unix_micros(F.col("ts").cast("timestamp"))
    fast = F.col("duration_ms") >= FAST_MS
    best = sessions.groupBy("user_id").agg(
        F.max("duration_ms").alias("longest_ms"), F.max_by("day", F.struct("duration_ms", early)).alias("longest_day"),
        F.max(F.when(fast, F.col("wpm"))).alias("fastest_wpm"), F.max_by("day", F.when(fast, F.struct("wpm", early))).alias("fastest_day"),
    )
    days = sessions.groupBy("user_id", "day").agg(F.sum("words").alias("words"))
    most = days.groupBy("user_id").agg(F.max("words").alias("most_words"), F.max_by("day", F.struct("words", F.datediff(F.lit("1970-01-01"), "day"))).alias("most_words_day"))
    return best.join(most, "user_id")


def weekly_rollup(sessions: DataFrame, as_of: str, keep_days: int = KEEP_DAYS) -> DataFrame:
    """K7: Monday weeks of the days older than ``keep_days``, with speed weighted by sessions."""
    old = sessions.where(F.col("day") < F.date_sub(F.lit(as_of).cast("date"), keep_days))
    return old.groupBy("user_id", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(
        F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.count_distinct("day").alias("active_days"), F.count("*").alias("sessions"), round_half_up(F.sum("wpm") / F.count("*")).alias("avg_wpm")
    )


def retained(rows: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """K8: rows of the last ``days`` days."""
    return rows.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def dense_series(daily: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """K9: a row for each of the last days of each user, zeros where nothing was read."""
    end = F.lit(as_of).cast("date")
    spine = daily.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return spine.join(daily, ["user_id", "day"], "left").select("user_id", "day", *map(zero, ("time_ms", "words", "sessions", "opened", "completed")))


def average_wpm(history: DataFrame) -> DataFrame:
    """Speed weighted by sessions."""
    return history.groupBy("user_id").agg(round_half_up(ratio(F.sum(F.col("avg_wpm") * F.col("sessions")), F.sum("sessions"))).alias("avg_wpm"))


def preset_bounds(preset: str, as_of: str, first: str | None = None, last: str | None = None) -> tuple[Column, Column]:
    """First and last day of 7d, 30d, 90d, 1y or all, or of ``custom``, whose bounds are given; an open one is that of all."""
    end = F.lit(as_of).cast("date")
    if preset == "custom":
        return F.lit(first or "1970-01-01").cast("date"), F.lit(last).cast("date") if last else end
    days = {"7d": 6, "30d": 29, "90d": 89, "1y": 364}
    return (F.date_sub(end, days[preset]) if preset in days else F.lit("1970-01-01").cast("date")), end


def period_totals(sessions: DataFrame, first: Column, last: Column) -> DataFrame:
    """Totals of each user between two days, both included."""
    return sessions.where(F.col("day").between(first, last)).groupBy("user_id").agg(
        F.sum("duration_ms").alias("time_ms"), F.sum("words").alias("words"), F.count_distinct("day").alias("active_days"), F.count("*").alias("sessions"), round_half_up(F.sum("wpm") / F.count("*")).alias("avg_wpm")
    )


def period_with_weeks(daily: DataFrame, history: DataFrame, weekly: DataFrame, first: Column, last: Column) -> DataFrame:
    """Totals of each user between two days from what a library keeps: days (K1), speeds of days (K4) and the weeks (K7, with
    completed and annotations) of the days before; a week counts where it begins in the range.  Speed is weighted by sessions."""
    days = daily.where(F.col("day").between(first, last)).join(history.select("user_id", "day", F.col("avg_wpm").alias("speed"), F.col("sessions").alias("timed")), ["user_id", "day"], "left")
    sums = ("time_ms", "words", "completed", "annotations")
    a = days.select("user_id", *sums, (F.col("time_ms") > 0).cast("long").alias("active_days"), F.coalesce("speed", F.lit(0)).alias("speed"), F.coalesce("timed", F.lit(0)).alias("timed"))
    timed = (F.col("avg_wpm") > 0) & (F.col("sessions") > 0)
    b = weekly.where(F.col("week").between(first, last)).select("user_id", *sums, F.col("active_days").cast("long").alias("active_days"), F.col("avg_wpm").alias("speed"), F.when(timed, F.col("sessions")).otherwise(0).alias("timed"))
    both = a.unionByName(b).groupBy("user_id").agg(*(F.sum(c).alias(c) for c in (*sums, "active_days")), F.sum("timed").alias("sessions"), F.sum(F.col("speed") * F.col("timed")).alias("weighted"))
    return both.withColumn("avg_wpm", round_half_up(ratio(F.col("weighted"), F.col("sessions")))).drop("weighted")


def period_start(unit: str, back: int, as_of: str) -> Column:
    """First day of the week, month or year that lies ``back`` periods before that of ``as_of``."""
    start = F.to_date(F.date_trunc(unit, F.lit(as_of).cast("date")))
    if unit == "week":
        return F.date_sub(start, 7 * back)
    return F.add_months(start, -back * (12 if unit == "year" else 1))


def percent_change(now: Column, before: Column) -> Column:
    change = round_half_up(ratio((now - before) * 100, before))
    return F.when(before > 0, change).when(now > 0, F.lit(100)).otherwise(F.lit(0)).cast("long")


def compare_periods(sessions: DataFrame, unit: str, as_of: str) -> DataFrame:
    """This period and the one before it, in one pass, with changes in percent."""
    start, before = period_start(unit, 0, as_of), period_start(unit, 1, as_of)
    now, then = F.col("day") >= start, F.col("day") < start
    zero = F.lit(0)
    sums = sessions.where((F.col("day") >= before) & (F.col("day") <= F.lit(as_of).cast("date"))).groupBy("user_id").agg(
        *(F.sum(F.when(w, F.col(c)).otherwise(zero)).alias(f"{n}_{a}") for a, w in (("now", now), ("before", then)) for c, n in (("duration_ms", "time"), ("words", "words")))
    )
    return sums.select("*", percent_change(F.col("time_now"), F.col("time_before")).alias("time_change"), percent_change(F.col("words_now"), F.col("words_before")).alias("words_change"))


def _levels(series: DataFrame, value: str) -> DataFrame:
    """Adds level 0 to 4; the bounds of the levels are the values at a quarter, half and three quarters of the ordered days with a value."""
    order = Window.partitionBy("user_id").orderBy(value, "day")
    read = series.where(F.col(value) > 0).select("user_id", F.col(value).alias("v"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col("v")))
    bounds = read.groupBy("user_id").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    v = F.col(value)
    level = F.when(v == 0, 0).when(v <= F.col("q1"), 1).when(v <= F.col("q2"), 2).when(v <= F.col("q3"), 3).otherwise(4)
    return series.join(bounds, "user_id", "left").withColumn("level", level.cast("long")).drop("q1", "q2", "q3")


def heatmap(series: DataFrame) -> DataFrame:
    """Time of each day with its level."""
    return _levels(series, "time_ms").select("user_id", "day", "time_ms", "level")


def heatmap_of(series: DataFrame, metric: str, weekly: DataFrame | None = None) -> DataFrame:
    """K15 by minutes (``time``), ``words``, ``documents`` or all three (``combined``, 0 to 100: shares of an hour, 5000 words and 5 documents):
    value and level of each day of a dense series.  A day without reading takes a seventh of its Monday week (K7 with completed), if
    there is one."""
    time, words, documents = F.col("time_ms") / F.lit(60000.0), F.col("words").cast("double"), F.col("opened").cast("double")
    rows = series
    if weekly is not None:
        weeks = weekly.select("user_id", "week", F.col("time_ms").alias("week_ms"), F.col("words").alias("week_words"), F.col("completed").alias("week_documents"))
        rows = series.withColumn("week", F.to_date(F.date_trunc("week", "day"))).join(weeks, ["user_id", "week"], "left")
        read = (F.col("time_ms") > 0) | (F.col("opened") > 0) | F.col("week_ms").isNull()
        seventh = lambda c, by=1.0: F.col(c) / F.lit(by) / F.lit(7.0)
        time, words, documents = F.when(read, time).otherwise(seventh("week_ms", 60000.0)), F.when(read, words).otherwise(seventh("week_words")), F.when(read, documents).otherwise(seventh("week_documents"))
    share = lambda x, full: F.least(x / F.lit(full), F.lit(1.0))
    values = {"time": time, "words": words, "documents": documents, "combined": (share(time, 60.0) + share(words, 5000.0) + share(documents, 5.0)) / F.lit(3.0) * F.lit(100.0)}
    return _levels(rows.select("user_id", "day", values[metric].alias("value")), "value").select("user_id", "day", F.lit(metric).alias("metric"), "value", "level")


def heatmap_summary(series: DataFrame) -> DataFrame:
    """Active days, total and average on active days; and the Sunday week in which the range begins."""
    sums = series.groupBy("user_id").agg(F.count_if(F.col("time_ms") > 0).alias("active_days"), F.sum("time_ms").alias("total_ms"), F.min("day").alias("first_day"))
    return sums.select("user_id", "active_days", "total_ms", round_half_up(ratio(F.col("total_ms"), F.col("active_days"))).alias("average_ms"), F.date_sub("first_day", F.dayofweek("first_day") - 1).alias("grid_start"))


def calendar_grid(series: DataFrame) -> DataFrame:
    """The days of a dense series on a grid of Sunday weeks: the week's number from the one in which the range begins, the day of the
    week (0 for Sunday), and the month's short name on the first day of the range and of each month."""
    first = F.min("day").over(Window.partitionBy("user_id"))
    rows = series.select("user_id", "day", "time_ms", first.alias("first"), (F.dayofweek("day") - 1).cast("long").alias("weekday"))
    week = F.floor((F.datediff("day", "first") + F.dayofweek("first") - 1) / 7).cast("long")
    starts = (F.col("day") == F.col("first")) | (F.dayofmonth("day") == 1)
    return rows.select("user_id", "day", "time_ms", week.alias("week"), "weekday", F.when(starts, F.date_format("day", "MMM")).alias("month"))


def charts(series: DataFrame, history: DataFrame, as_of: str, bars: int = 14, sparks: int = 7) -> DataFrame:
    """What the charts draw of each day of a dense series: minutes and words of the last ``bars`` days, the mean speed of days that
    have one, and whether the day is one of the ``sparks`` of the small charts."""
    speeds = history.select("user_id", "day", F.col("avg_wpm").alias("wpm"))
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    recent = lambda c: F.when(age < bars, c)
    rows = series.join(speeds, ["user_id", "day"], "left")
    return rows.select("user_id", "day", recent(round_half_up(F.col("time_ms") / 60000.0)).alias("minutes"), recent(F.col("words")).alias("words"), "wpm", (age < sparks).alias("in_sparkline"))


def daily_average(daily: DataFrame) -> DataFrame:
    """Minutes a day over active days."""
    return daily.groupBy("user_id").agg(round_half_up(ratio(F.sum("time_ms"), F.count_if(F.col("time_ms") > 0)) / 60000.0).alias("minutes"))


def finish_rate(sessions: DataFrame) -> DataFrame:
    """Distinct completed to distinct opened documents, in percent."""
    n = sessions.groupBy("user_id").agg(F.count_distinct("document_id").alias("opened"), F.count_distinct(F.when(F.col("completed"), F.col("document_id"))).alias("completed"))
    return n.select("*", round_half_up(ratio(F.col("completed") * 100, F.col("opened"))).alias("finish_rate"))


def rolling_averages(sessions: DataFrame, as_of: str) -> DataFrame:
    """Averages of 7 and 30 days on active days, sessions a day, speed, and the trend at 15 percent."""
    out, end = sessions.where(F.col("day").between(F.date_sub(F.lit(as_of).cast("date"), 29), F.lit(as_of).cast("date"))), F.lit(as_of).cast("date")
    aggs = []
    for n in (7, 30):
        inside = F.col("day") > F.date_sub(end, n)
        aggs += [F.sum(F.when(inside, F.col("duration_ms")).otherwise(0)).alias(f"t{n}"), F.sum(F.when(inside, F.col("words")).otherwise(0)).alias(f"w{n}"), F.count_distinct(F.when(inside, F.col("day"))).alias(f"d{n}"), F.count_if(inside).alias(f"s{n}"), F.sum(F.when(inside, F.col("wpm")).otherwise(0)).alias(f"v{n}")]
    sums = out.groupBy("user_id").agg(*aggs)
    cols = []
    for n in (7, 30):
        t, w, d, s, v = (F.col(f"{c}{n}") for c in "twdsv")
        cols += [round_half_up(ratio(t, d) / 60000.0).alias(f"minutes_{n}"), round_half_up(ratio(w, d)).alias(f"words_{n}"), round_half_up(ratio(v, s)).alias(f"wpm_{n}"), round_half_up(s.cast("double") / F.lit(float(n)) * 10).alias(f"sessions_x10_{n}")]
    rolled = sums.select("user_id", *cols)
    share = F.try_divide(F.col("minutes_7").cast("double"), F.col("minutes_30").cast("double"))
    trend = F.when(F.col("minutes_30") <= 0, "stable").when(share > 1.15, "improving").when(share < 0.85, "declining").otherwise("stable")
    return rolled.select("*", trend.alias("trend"))


def rolling_series(daily: DataFrame) -> DataFrame:
    """K19 of every day of a user: averages of the 7 and 30 days up to it on days with time, and sessions a day in tenths. The frames are
    ranges of days, so days without reading need no rows; a user's days are one partition of the window."""
    place = F.datediff("day", F.lit("1970-01-01").cast("date"))
    cols = []
    for n in (7, 30):
        frame = Window.partitionBy("user_id").orderBy("place").rangeBetween(1 - n, 0)
        active = F.sum((F.col("time_ms") > 0).cast("int")).over(frame)
        cols += [round_half_up(ratio(F.sum("time_ms").over(frame), active) / 60000.0).alias(f"minutes_{n}"), round_half_up(ratio(F.sum("words").over(frame), active)).alias(f"words_{n}"), round_half_up(F.sum("sessions").over(frame).cast("double") / F.lit(float(n)) * 10).alias(f"sessions_x10_{n}")]
    return daily.withColumn("place", place).select("user_id", "day", *cols)


def weekday_patterns(series: DataFrame) -> DataFrame:
    """Average time of each weekday (0 = Sunday) over a dense series, and its rank, the earlier weekday on ties."""
    days = series.groupBy("user_id", (F.dayofweek("day") - 1).cast("long").alias("weekday")).agg(round_half_up(ratio(F.sum("time_ms"), F.count("*"))).alias("average_ms"), F.count_if(F.col("time_ms") > 0).alias("active_days"))
    return days.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("average_ms"), "weekday")).cast("long"))


def pattern_insights(series: DataFrame, streaks: DataFrame, as_of: str) -> DataFrame:
    """Of a dense series of 90 days and the current streaks: minutes on weekdays and at weekends, the share of weekends, which of them
    is read more in (by over 1.3), the weekdays with most and least minutes (the earlier on ties for most, the later for least), the
    share of the last 30 days with reading, and how steady a reader is."""
    recent = F.col("day") > F.date_sub(F.lit(as_of).cast("date"), 30)
    days = series.groupBy("user_id", (F.dayofweek("day") - 1).cast("long").alias("weekday")).agg(F.sum("time_ms").alias("ms"), F.count("*").alias("n"), F.count_if(recent & (F.col("time_ms") > 0)).alias("active"))
    timed = days.select("*", round_half_up(F.col("ms") / 60000.0).alias("total"), round_half_up(ratio(F.col("ms"), F.col("n")) / 60000.0).alias("average"), F.col("weekday").isin(0, 6).alias("weekend"))
    side = lambda c, at_end: F.sum(F.when(F.col("weekend") == at_end, F.col(c)).otherwise(0))
    rank = lambda sign: F.struct("average", sign * F.col("weekday"))
    users = timed.groupBy("user_id").agg(
        side("total", False).alias("week_total"), side("total", True).alias("end_total"), side("n", False).alias("week_n"), side("n", True).alias("end_n"), F.sum("active").alias("active"),
        F.max_by("weekday", rank(-1)).alias("best_day"), F.max("average").alias("best_minutes"), F.min_by("weekday", rank(-1)).alias("worst_day"), F.min("average").alias("worst_minutes"),
    )
    week, end = round_half_up(ratio(F.col("week_total"), F.col("week_n"))), round_half_up(ratio(F.col("end_total"), F.col("end_n")))
    shown = users.select("*", week.alias("weekday_minutes"), end.alias("weekend_minutes"), round_half_up(ratio(F.col("end_total"), F.col("week_total") + F.col("end_total")) * 100).alias("weekend_percent"), round_half_up(F.col("active") / F.lit(30.0) * 100).alias("active_percent"))
    more = F.when(F.col("weekend_minutes") > F.col("weekday_minutes") * F.lit(1.3), "weekend").when(F.col("weekday_minutes") > F.col("weekend_minutes") * F.lit(1.3), "weekday").otherwise("balanced")
    steady = F.when(F.coalesce("current_streak", F.lit(0)) >= 7, "on-fire").when(F.col("active_percent") >= 50, "consistent").when(F.col("active_percent") >= 20, "sporadic").otherwise("inactive")
    joined = shown.join(streaks.select("user_id", "current_streak"), "user_id", "left")
    return joined.select("user_id", "weekday_minutes", "weekend_minutes", "weekend_percent", more.alias("preference"), "best_day", "best_minutes", "worst_day", "worst_minutes", "active_percent", steady.alias("streak_status"))


def goal_progress(daily: DataFrame, sessions: DataFrame, goals: DataFrame, as_of: str) -> DataFrame:
    """Minutes today and this week and documents this month against the goals, in percent up to 100."""
    today = F.lit(as_of).cast("date")
    minutes = daily.groupBy("user_id").agg(F.sum(F.when(F.col("day") == today, F.col("time_ms")).otherwise(0)).alias("day_ms"), F.sum(F.when((F.col("day") >= period_start("week", 0, as_of)) & (F.col("day") <= today), F.col("time_ms")).otherwise(0)).alias("week_ms"), F.sum(F.when((F.col("day") >= period_start("month", 0, as_of)) & (F.col("day") <= today), F.col("completed")).otherwise(0)).alias("documents"))
    j = goals.join(minutes, "user_id").select("user_id", "daily_minutes", "weekly_minutes", "monthly_documents", round_half_up(F.col("day_ms") / 60000.0).alias("day_minutes"), round_half_up(F.col("week_ms") / 60000.0).alias("week_minutes"), "documents")
    part = lambda now, goal: F.least(F.lit(100).cast("long"), round_half_up(ratio(F.col(now) * 100, F.col(goal))))
    return j.select("user_id", "day_minutes", "week_minutes", "documents", part("day_minutes", "daily_minutes").alias("daily_percent"), part("week_minutes", "weekly_minutes").alias("weekly_percent"), part("documents", "monthly_documents").alias("monthly_percent"))


def goal_crossings(sessions: DataFrame, goals: DataFrame) -> DataFrame:
    """The session with which a user's time of a day reaches the daily goal."""
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = sessions.join(goals, "user_id").withColumn("total_ms", F.sum("duration_ms").over(order))
    goal = F.col("daily_minutes") * 60000
    return run.where((F.col("total_ms") >= goal) & (F.col("total_ms") - F.col("duration_ms") < goal)).select("user_id", "day", "event_id", "total_ms")


def duration_label(ms: Column) -> Column:
    """``Xh Ym``, or ``Ym`` under an hour."""
    minutes = F.floor(ms / 60000.0).cast("long")
    hours, rest = F.floor(minutes / 60.0).cast("long"), minutes % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def projections(sessions: DataFrame, daily: DataFrame, backlog: DataFrame, as_of: str) -> DataFrame:
    """Hours, words and books of a year, days until the backlog (user_id, backlog) is read, and milestones; null where the
    user's pace does not say."""
    end = F.lit(as_of).cast("date")
    lately = daily.where(F.col("day").between(F.date_sub(end, 89), end)).groupBy("user_id").agg(F.sum("completed").alias("recent"))
    totals = lifetime_totals(daily).select("user_id", F.col("completed").alias("all_completed"), F.col("words").alias("all_words"))
    j = rolling_averages(sessions, as_of).join(lately, "user_id", "left").join(totals, "user_id").join(backlog, "user_id", "left").na.fill(0, ["recent", "backlog"])
    rate, words, minutes = F.col("recent") / F.lit(90.0), F.col("words_30"), F.col("minutes_30")
    enough = F.col("recent") >= 3
    per = lambda n, pace: F.when(pace > 0, round_half_up(F.try_divide(n.cast("double"), pace.cast("double"))))
    return j.select(
        "user_id", round_half_up(minutes * F.lit(365) / F.lit(60.0)).alias("hours_per_year"), (words * 365).alias("words_per_year"),
        F.when(enough, round_half_up(rate * 365)).otherwise(round_half_up(words * 365 / F.lit(50000.0))).alias("books_per_year"), F.when(enough, "completion-rate").otherwise("reading-pace").alias("based_on"),
        F.when(minutes < 15, "low").when(enough, "high").otherwise("medium").alias("confidence"), per(F.col("backlog"), rate).alias("backlog_days"), per(F.lit(1), rate).alias("next_book_days"),
        F.when(F.col("all_completed") < 100, per(F.lit(100) - F.col("all_completed"), rate)).alias("hundred_books_days"), F.when(F.col("all_words") < 1000000, per(F.lit(1000000) - F.col("all_words"), words)).alias("million_words_days"),
    )


def sparklines(series: DataFrame) -> DataFrame:
    """Minutes of the days of a dense series, oldest first, comma-joined, and their greatest."""
    minutes = round_half_up(F.col("time_ms") / 60000.0)
    rows = series.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", minutes.alias("m")))).alias("rows"))
    return rows.select("user_id", F.array_join(F.transform("rows", lambda r: r["m"].cast("string")), ",").alias("minutes"), F.array_max(F.transform("rows", lambda r: r["m"])).alias("most"))


def habit_scores(kpis: DataFrame) -> DataFrame:
    """Six scores up to 100 from current_streak, avg_wpm, minutes (a day), types, finish_rate and annotations; a row each."""
    top = lambda c: F.least(F.lit(100), c).cast("long")
    share = lambda c, full: top(round_half_up(F.col(c) / F.lit(float(full)) * 100))
    scores = {"Consistency": top(F.col("current_streak") * 10), "Speed": share("avg_wpm", 400), "Volume": share("minutes", 60), "Variety": top(F.col("types") * 25), "Completion": F.col("finish_rate").cast("long"), "Engagement": share("annotations", 50)}
    return kpis.select("user_id", F.explode(F.array(*(F.struct(F.lit(k).alias("habit"), v.alias("score")) for k, v in scores.items()))).alias("s")).select("user_id", "s.habit", "s.score")


def current_goals(changes: DataFrame) -> DataFrame:
    """The newest goal of each user from changes (user_id, ts, event_id, daily_minutes)."""
    return changes.groupBy("user_id").agg(F.max_by("daily_minutes", F.struct("ts", "event_id")).alias("daily_minutes"))
