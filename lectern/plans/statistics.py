"""Queries of the reading statistics and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from lectern.operators import stats as K
from lectern.operators.exports import weekly_sections
from lectern.sources import bindings as B

SESSIONS = """sessions as (select event_id, user_id, ts, ts::date as day, floor(value * 1000)::bigint as duration_ms, json_extract(props, '$.k')::bigint as document_id, event_type = 'purchase' as completed, 150 + event_id % 250 as wpm,
 floor(floor(value * 1000)::bigint::double / 60000.0 * (150 + event_id % 250) + 0.5)::bigint as words from events where event_type in ('view', 'click', 'purchase') and floor(value * 1000) >= 5000)"""
LONG = """sessions as (select o_orderkey as event_id, o_custkey as user_id, o_orderdate as ts, o_orderdate::date as day, floor(o_totalprice)::bigint as duration_ms, o_orderkey % 500 as document_id, o_orderstatus = 'F' as completed, 150 + o_orderkey % 250 as wpm,
 floor(floor(o_totalprice)::bigint::double / 60000.0 * (150 + o_orderkey % 250) + 0.5)::bigint as words from orders where floor(o_totalprice) >= 5000)"""
DAILY = f"""{SESSIONS}, noted as (select user_id, ts::date as day, count(*) as annotations from events where event_type = 'signup' group by all),
read as (select user_id, day, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(*) as sessions, count(distinct document_id) as opened, count(distinct document_id) filter (completed) as completed from sessions group by all),
daily as (select user_id, day, coalesce(time_ms, 0) as time_ms, coalesce(words, 0) as words, coalesce(sessions, 0) as sessions, coalesce(opened, 0) as opened, coalesce(completed, 0) as completed, coalesce(annotations, 0) as annotations from read full join noted using (user_id, day))"""
SERIES = """spine as (select user_id, unnest(generate_series(date '{a}' - {n}, date '{a}', interval 1 day))::date as day from (select distinct user_id from daily)),
series as (select s.user_id, s.day, coalesce(d.time_ms, 0) as time_ms, coalesce(d.words, 0) as words, coalesce(d.sessions, 0) as sessions, coalesce(d.opened, 0) as opened, coalesce(d.completed, 0) as completed from spine s left join daily d using (user_id, day))"""
HISTORY = "history as (select * from (select user_id, day, floor(sum(wpm)::double / count(*) + 0.5)::bigint as avg_wpm, count(*) as sessions from sessions group by all) qualify row_number() over (partition by user_id order by day desc) <= 90)"
GOALS = "goals as (select user_id, 1 + user_id % 5 as daily_minutes, 5 + user_id % 20 as weekly_minutes, 1 + user_id % 4 as monthly_documents from (select distinct user_id from sessions))"
HOURLY = "hourly as (select user_id, hour, coalesce(time_ms, 0) as time_ms, coalesce(n, 0) as sessions from (select user_id, unnest(range(24)) as hour from (select distinct user_id from sessions)) left join (select user_id, hour(ts) as hour, sum(duration_ms)::bigint as time_ms, count(*) as n from sessions group by all) using (user_id, hour))"


def _daily(s, d):
    return K.daily_rollup(B.sessions(s, d), B.annotation_events(s, d))


def _series(s, d, n=30):
    return K.dense_series(_daily(s, d), B.AS_OF, n)


def _goals(sessions):
    return sessions.select("user_id").distinct().select("user_id", (1 + F.col("user_id") % 5).alias("daily_minutes"), (5 + F.col("user_id") % 20).alias("weekly_minutes"), (1 + F.col("user_id") % 4).alias("monthly_documents"))


def _period_with_weeks(s, d):
    sessions, notes = B.sessions_long(s, d), B.annotation_events(s, d)
    daily = K.retained(K.daily_rollup(sessions, notes), "day", B.AS_OF_LONG, K.KEEP_DAYS)
    weekly = weekly_sections(sessions, notes, B.AS_OF_LONG)
    return K.period_with_weeks(daily, K.wpm_history(sessions), weekly, *K.preset_bounds("1y", B.AS_OF_LONG))


METRICS = {"time": "time_ms / 60000.0::double", "words": "words::double", "documents": "opened::double", "combined": "(least(time_ms / 3600000.0::double, 1) + least(words / 5000.0::double, 1) + least(opened / 5.0::double, 1)) / 3.0::double * 100.0::double"}


def _heatmap_sql() -> str:
    values = " union all ".join(f"select user_id, day, '{m}' as metric, {v} as value from series" for m, v in METRICS.items())
    bound = lambda q: f"max(value) filter (i = floor(n * {q}::double))"
    return f"""with {DAILY}, {SERIES.format(a=B.AS_OF, n=29)}, v as ({values}), r as (select *, row_number() over (partition by user_id, metric order by value, day) - 1 as i, count(*) over (partition by user_id, metric) as n from v where value > 0),
b as (select user_id, metric, {bound(0.25)} as q1, {bound(0.5)} as q2, {bound(0.75)} as q3 from r group by all)
select user_id, day, metric, round(value, 6) as value, case when value = 0 then 0 when value <= q1 then 1 when value <= q2 then 2 when value <= q3 then 3 else 4 end::bigint as level from v left join b using (user_id, metric)"""


def _series_sql() -> str:
    cols = []
    for n in (7, 30):
        over = f"over (partition by user_id order by day range between interval {n - 1} days preceding and current row)"
        active = f"nullif(sum((time_ms > 0)::int) {over}, 0)"
        half = lambda x: f"floor({x} + 0.5::double)::bigint"
        cols += [half(f"coalesce(sum(time_ms) {over}::double / {active}, 0) / 60000.0::double") + f" as minutes_{n}", half(f"coalesce(sum(words) {over}::double / {active}, 0)") + f" as words_{n}", half(f"sum(sessions) {over}::double / {n}.0::double * 10") + f" as sessions_x10_{n}"]
    return f"with {DAILY} select user_id, day, {', '.join(cols)} from daily"


QUERIES = {
    "a01_session_source": lambda s, d: B.sessions(s, d).select("event_id", "user_id", "day", "duration_ms", "document_id", "completed", "wpm", "words"),
    "k01_daily_rollup": _daily,
    "k02_lifetime_totals": lambda s, d: K.lifetime_totals(_daily(s, d)),
    "k03_streaks": lambda s, d: K.streaks(_daily(s, d)),
    "k04_wpm_history": lambda s, d: K.wpm_history(B.sessions(s, d)),
    "k05_hourly_activity": lambda s, d: K.hourly_activity(B.sessions(s, d)),
    "k05_best_hour": lambda s, d: K.best_hour(K.hourly_activity(B.sessions(s, d))),
    "k06_personal_bests": lambda s, d: K.personal_bests(B.sessions(s, d)),
    "k07_weekly_rollup": lambda s, d: K.weekly_rollup(B.sessions_long(s, d), B.AS_OF_LONG),
    "k08_retention": lambda s, d: K.retained(K.weekly_rollup(B.sessions_long(s, d), B.AS_OF_LONG), "week", B.AS_OF_LONG, 7 * K.KEEP_WEEKS),
    "k09_dense_series": _series,
    "k10_average_wpm": lambda s, d: K.average_wpm(K.wpm_history(B.sessions(s, d))),
    "k12_period_totals": lambda s, d: K.period_totals(B.sessions_long(s, d), *K.preset_bounds("1y", B.AS_OF_LONG)),
    "k14_compare_periods": lambda s, d: K.compare_periods(B.sessions_long(s, d), "year", B.AS_OF_LONG),
    "k12_period_with_weeks": _period_with_weeks,
    "k12_custom_totals": lambda s, d: K.period_totals(B.sessions_long(s, d), *K.preset_bounds("custom", B.AS_OF_LONG, "1996-03-05", "1998-11-20")),
    "k20_pattern_insights": lambda s, d: K.pattern_insights(_series(s, d, 90), K.streaks(_daily(s, d)), B.AS_OF),
    "k15_heatmap_metrics": lambda s, d: functools.reduce(lambda a, b: a.unionByName(b), (K.heatmap_of(_series(s, d), m) for m in METRICS)).withColumn("value", F.round("value", 6)),
    "k19_rolling_series": lambda s, d: K.rolling_series(_daily(s, d)),
    "k15_heatmap": lambda s, d: K.heatmap(_series(s, d)),
    "k16_calendar_grid": lambda s, d: K.calendar_grid(_series(s, d, 60)),
    "k16_heatmap_summary": lambda s, d: K.heatmap_summary(_series(s, d)),
    "k17_daily_average": lambda s, d: K.daily_average(_daily(s, d)),
    "k18_finish_rate": lambda s, d: K.finish_rate(B.sessions(s, d)),
    "k19_rolling_averages": lambda s, d: K.rolling_averages(B.sessions(s, d), B.AS_OF),
    "k20_weekday_patterns": lambda s, d: K.weekday_patterns(_series(s, d, 28)),
    "k22_goal_progress": lambda s, d: K.goal_progress(_daily(s, d), B.sessions(s, d), _goals(B.sessions(s, d)), B.AS_OF),
    "k23_goal_crossings": lambda s, d: K.goal_crossings(B.sessions(s, d), _goals(B.sessions(s, d))),
    "k24_annotation_activity": lambda s, d: K.annotation_activity(B.annotation_events(s, d)),
    "k27_duration_labels": lambda s, d: K.lifetime_totals(_daily(s, d)).select("user_id", K.duration_label(F.col("time_ms")).alias("label")),
}

_ROUND = "floor({} + 0.5)::bigint"
_LONG_SUMS = "sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(distinct day) as active_days, count(*) as sessions, floor(sum(wpm)::double / count(*) + 0.5)::bigint as avg_wpm"
_WEEKS = f"weeks as (select user_id, date_trunc('week', day)::date as week, {_LONG_SUMS} from sessions where day < date '{B.AS_OF_LONG}' - 90 group by all)"
_AVG = "floor(coalesce({a}::double / nullif({b}, 0), 0) {c} + 0.5)::bigint"


def _rolled(n: int) -> str:
    inside = f"day > date '{B.AS_OF}' - {n}"
    t, w, d, s, v = (f"{x} filter ({inside})" for x in ("sum(duration_ms)", "sum(words)", "count(distinct day)", "count(*)", "sum(wpm)"))
    return f"{_AVG.format(a=f'coalesce({t}, 0)', b=d, c='/ 60000.0')} as minutes_{n}, {_AVG.format(a=f'coalesce({w}, 0)', b=d, c='')} as words_{n}, {_AVG.format(a=f'coalesce({v}, 0)', b=s, c='')} as wpm_{n}, floor(({s})::double / {n}.0::double * 10 + 0.5)::bigint as sessions_x10_{n}"


def _change(a: str, b: str) -> str:
    return f"case when {b} > 0 then floor(({a} - {b}) * 100::double / {b} + 0.5)::bigint when {a} > 0 then 100 else 0 end"


ORACLE_SQL = {
    "a01_session_source": f"with {SESSIONS} select event_id, user_id, day, duration_ms, document_id, completed, wpm, words from sessions",
    "k01_daily_rollup": f"with {DAILY} select * from daily",
    "k02_lifetime_totals": f"with {DAILY} select user_id, sum(time_ms)::bigint as time_ms, sum(words)::bigint as words, sum(sessions)::bigint as sessions, sum(completed)::bigint as completed, sum(annotations)::bigint as annotations, count(*) filter (time_ms > 0) as active_days from daily group by user_id",
    "k03_streaks": f"with {DAILY}, runs as (select user_id, count(*) as days, max(day) as last from (select user_id, day, day - row_number() over (partition by user_id order by day)::int as run from daily) group by user_id, run) select user_id, arg_max(days, last) as current_streak, max(days) as longest_streak, max(last) as last_day from runs group by user_id",
    "k04_wpm_history": f"with {SESSIONS}, {HISTORY} select * from history",
    "k05_hourly_activity": f"with {SESSIONS}, {HOURLY} select * from hourly",
    "k05_best_hour": f"with {SESSIONS}, {HOURLY} select user_id, hour as best_hour, time_ms from hourly qualify row_number() over (partition by user_id order by time_ms desc, hour) = 1",
    "k06_personal_bests": f"""with {SESSIONS},
a as (select user_id, duration_ms as longest_ms, day as longest_day from sessions qualify row_number() over (partition by user_id order by duration_ms desc, ts) = 1),
f as (select user_id, wpm as fastest_wpm, day as fastest_day from sessions where duration_ms >= 60000 qualify row_number() over (partition by user_id order by wpm desc, ts) = 1),
w as (select user_id, words as most_words, day as most_words_day from (select user_id, day, sum(words)::bigint as words from sessions group by all) qualify row_number() over (partition by user_id order by words desc, day) = 1)
select * from a left join f using (user_id) join w using (user_id)""",
    "k07_weekly_rollup": f"with {LONG}, {_WEEKS} select * from weeks",
    "k08_retention": f"with {LONG}, {_WEEKS} select * from weeks where week >= date '{B.AS_OF_LONG}' - 728",
    "k09_dense_series": f"with {DAILY}, {SERIES.format(a=B.AS_OF, n=29)} select * from series",
    "k10_average_wpm": f"with {SESSIONS}, {HISTORY} select user_id, floor(sum(avg_wpm * sessions)::double / sum(sessions) + 0.5)::bigint as avg_wpm from history group by user_id",
    "k12_period_totals": f"with {LONG} select user_id, {_LONG_SUMS} from sessions where day between date '{B.AS_OF_LONG}' - 364 and date '{B.AS_OF_LONG}' group by user_id",
    "k14_compare_periods": f"""with {LONG}, s as (select user_id, coalesce(sum(duration_ms) filter (day >= date '2001-01-01'), 0)::bigint as time_now, coalesce(sum(words) filter (day >= date '2001-01-01'), 0)::bigint as words_now, coalesce(sum(duration_ms) filter (day < date '2001-01-01'), 0)::bigint as time_before,
coalesce(sum(words) filter (day < date '2001-01-01'), 0)::bigint as words_before from sessions where day between date '2000-01-01' and date '{B.AS_OF_LONG}' group by user_id) select *, {_change("time_now", "time_before")} as time_change, {_change("words_now", "words_before")} as words_change from s""",
    "k12_custom_totals": f"with {LONG} select user_id, {_LONG_SUMS} from sessions where day between date '1996-03-05' and date '1998-11-20' group by user_id",
    "k12_period_with_weeks": f"""with {LONG}, d as (select user_id, day, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(distinct document_id) filter (completed) as completed, floor(sum(wpm)::double / count(*) + 0.5)::bigint as speed, count(*) as n from sessions where day >= date '{B.AS_OF_LONG}' - 90 group by all),
w as (select user_id, date_trunc('week', day)::date as week, sum(duration_ms)::bigint as time_ms, sum(words)::bigint as words, count(distinct (day, document_id)) filter (completed) as completed, count(distinct day) as active, floor(sum(wpm)::double / count(*) + 0.5)::bigint as speed, count(*) as n from sessions where day < date '{B.AS_OF_LONG}' - 90 group by all),
p as (select user_id, time_ms, words, completed, (time_ms > 0)::int as active, speed, n from d where day <= date '{B.AS_OF_LONG}' union all select user_id, time_ms, words, completed, active, speed, n from w where week between date '{B.AS_OF_LONG}' - 364 and date '{B.AS_OF_LONG}')
select user_id, sum(time_ms)::bigint as time_ms, sum(words)::bigint as words, sum(completed)::bigint as completed, 0::bigint as annotations, sum(active)::bigint as active_days, sum(n)::bigint as sessions, floor(sum(speed * n)::double / sum(n) + 0.5)::bigint as avg_wpm from p group by user_id""",
    "k20_pattern_insights": f"""with {DAILY}, {SERIES.format(a=B.AS_OF, n=89)}, runs as (select user_id, count(*) as days, max(day) as last from (select user_id, day, day - row_number() over (partition by user_id order by day)::int as run from daily) group by user_id, run), k as (select user_id, arg_max(days, last) as streak from runs group by user_id),
t as (select user_id, dayofweek(day) as weekday, sum(time_ms)::bigint as ms, count(*) as n, count(*) filter (day > date '{B.AS_OF}' - 30 and time_ms > 0) as active from series group by all),
m as (select *, floor(ms / 60000.0::double + 0.5::double)::bigint as total, floor(ms::double / n / 60000.0::double + 0.5::double)::bigint as average, weekday in (0, 6) as weekend from t),
u as (select user_id, floor(sum(total) filter (not weekend)::double / sum(n) filter (not weekend) + 0.5::double)::bigint as a, floor(sum(total) filter (weekend)::double / sum(n) filter (weekend) + 0.5::double)::bigint as b, floor(coalesce(sum(total) filter (weekend)::double / nullif(sum(total), 0), 0) * 100 + 0.5::double)::bigint as share, floor(sum(active) / 30.0::double * 100 + 0.5::double)::bigint as active from m group by user_id),
best as (select user_id, weekday, average from m qualify row_number() over (partition by user_id order by average desc, weekday) = 1), worst as (select user_id, weekday, average from m qualify row_number() over (partition by user_id order by average, weekday desc) = 1)
select user_id, a as weekday_minutes, b as weekend_minutes, share as weekend_percent, case when b > a * 1.3::double then 'weekend' when a > b * 1.3::double then 'weekday' else 'balanced' end as preference, best.weekday as best_day, best.average as best_minutes, worst.weekday as worst_day, worst.average as worst_minutes, active as active_percent,
case when streak >= 7 then 'on-fire' when active >= 50 then 'consistent' when active >= 20 then 'sporadic' else 'inactive' end as streak_status from u join k using (user_id) join best using (user_id) join worst using (user_id)""",
    "k15_heatmap_metrics": _heatmap_sql(),
    "k19_rolling_series": _series_sql(),
    "k15_heatmap": f"""with {DAILY}, {SERIES.format(a=B.AS_OF, n=29)}, r as (select user_id, time_ms, row_number() over (partition by user_id order by time_ms, day) - 1 as i, count(*) over (partition by user_id) as n from series where time_ms > 0),
q as (select user_id, max(time_ms) filter (i = floor(n * 0.25)) as q1, max(time_ms) filter (i = floor(n * 0.5)) as q2, max(time_ms) filter (i = floor(n * 0.75)) as q3 from r group by user_id)
select user_id, day, time_ms, (case when time_ms = 0 then 0 when time_ms <= q1 then 1 when time_ms <= q2 then 2 when time_ms <= q3 then 3 else 4 end)::bigint as level from series left join q using (user_id)""",
    "k16_calendar_grid": f"with {DAILY}, {SERIES.format(a=B.AS_OF, n=59)}, f as (select *, min(day) over (partition by user_id) as first from series) select user_id, day, time_ms, (date_diff('day', first, day) + dayofweek(first)) // 7 as week, dayofweek(day)::bigint as weekday, case when day = first or dayofmonth(day) = 1 then strftime(day, '%b') end as month from f",
    "k16_heatmap_summary": f"with {DAILY}, {SERIES.format(a=B.AS_OF, n=29)} select user_id, count(*) filter (time_ms > 0) as active_days, sum(time_ms)::bigint as total_ms, {_AVG.format(a='sum(time_ms)', b='count(*) filter (time_ms > 0)', c='')} as average_ms, (min(day) - dayofweek(min(day))::int) as grid_start from series group by user_id",
    "k17_daily_average": f"with {DAILY} select user_id, {_AVG.format(a='sum(time_ms)', b='count(*) filter (time_ms > 0)', c='/ 60000.0')} as minutes from daily group by user_id",
    "k18_finish_rate": f"with {SESSIONS}, n as (select user_id, count(distinct document_id) as opened, count(distinct document_id) filter (completed) as completed from sessions group by user_id) select *, floor(completed * 100::double / opened + 0.5)::bigint as finish_rate from n",
    "k19_rolling_averages": f"""with {SESSIONS}, r as (select user_id, {_rolled(7)}, {_rolled(30)} from sessions where day between date '{B.AS_OF}' - 29 and date '{B.AS_OF}' group by user_id)
select *, case when minutes_30 <= 0 then 'stable' when minutes_7::double / minutes_30 > 1.15 then 'improving' when minutes_7::double / minutes_30 < 0.85 then 'declining' else 'stable' end as trend from r""",
    "k20_weekday_patterns": f"with {DAILY}, {SERIES.format(a=B.AS_OF, n=27)}, w as (select user_id, dayofweek(day) as weekday, {_AVG.format(a='sum(time_ms)', b='count(*)', c='')} as average_ms, count(*) filter (time_ms > 0) as active_days from series group by all) select *, row_number() over (partition by user_id order by average_ms desc, weekday) as rank from w",
    "k22_goal_progress": f"""with {DAILY}, {GOALS}, m as (select user_id, floor(coalesce(sum(time_ms) filter (day = date '{B.AS_OF}'), 0) / 60000.0::double + 0.5)::bigint as day_minutes, floor(coalesce(sum(time_ms) filter (day between date_trunc('week', date '{B.AS_OF}') and date '{B.AS_OF}'), 0) / 60000.0::double + 0.5)::bigint as week_minutes,
coalesce(sum(completed) filter (day between date_trunc('month', date '{B.AS_OF}') and date '{B.AS_OF}'), 0)::bigint as documents from daily group by user_id)
select user_id, day_minutes, week_minutes, documents, least(100, floor(day_minutes * 100::double / daily_minutes + 0.5)::bigint) as daily_percent, least(100, floor(week_minutes * 100::double / weekly_minutes + 0.5)::bigint) as weekly_percent, least(100, floor(documents * 100::double / monthly_documents + 0.5)::bigint) as monthly_percent from goals join m using (user_id)""",
    "k23_goal_crossings": f"with {SESSIONS}, {GOALS}, r as (select *, sum(duration_ms) over (partition by user_id, day order by ts, event_id rows unbounded preceding)::bigint as total_ms from sessions join goals using (user_id)) select user_id, day, event_id, total_ms from r where total_ms >= daily_minutes * 60000 and total_ms - duration_ms < daily_minutes * 60000",
    "k24_annotation_activity": "select user_id, ts::date as day, count(*) as annotations from events where event_type = 'signup' group by all",
    "k27_duration_labels": f"with {DAILY}, t as (select user_id, floor(sum(time_ms) / 60000.0::double)::bigint as m from daily group by user_id) select user_id, case when m >= 60 then (m // 60) || 'h ' || (m % 60) || 'm' else m || 'm' end as label from t",
}
