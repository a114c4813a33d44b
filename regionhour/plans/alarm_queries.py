"""Registered queries over alarm intervals, each with the same result in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.functions import calendar, numeric, text
from regionhour.operators import alarms as ops
from regionhour.operators import profile
from regionhour.plans.lenses import Lenses, with_views


def r6(c: str | Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def round_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def named(v: Lenses) -> DataFrame:
    return ops.with_region(v.alarms, v.regions)


def alarm_profile_input(v: Lenses) -> DataFrame:
    """Alarms with some empty cells and repeated rows."""
    return v.alarms.select(
        F.when(F.col("id") % 10 != 0, F.col("alert_type")).alias("alert_type"),
        "region_id", "all_region",
        F.when(F.col("id") % 7 != 0, F.hour("start")).alias("hour"),
    )


PROFILE_SQL = """
    SELECT CASE WHEN id % 10 <> 0 THEN alert_type END AS alert_type, region_id, all_region,
           CASE WHEN id % 7 <> 0 THEN CAST(hour(start_ts) AS INT) END AS hour
    FROM alarms"""

DURATIONS = {
    "durations": """
        SELECT (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0 AS m FROM alarms WHERE end_ts > start_ts"""
}
DAILY = {"daily": "SELECT CAST(start_ts AS DATE) AS d, count(*) AS n FROM alarms GROUP BY 1"}
ORDER_DAILY = {"daily": "SELECT CAST(start_ts AS DATE) AS d, count(*) AS n FROM order_starts GROUP BY 1"}


def calendar_parts(v: Lenses) -> DataFrame:
    parts = calendar.calendar_parts(v.alarms.select("id", "start"), "start").drop("start")
    return parts.withColumn("date_only", day_text("date_only"))


def duration_minutes(v: Lenses) -> DataFrame:
    return ops.with_duration(v.alarms).select("id", r6("duration_minutes").alias("duration_minutes"), F.col("valid").cast("int").alias("valid"))


def probability_bands(v: Lenses) -> DataFrame:
    p = F.abs(F.sin(F.col("id") * 1.0))
    return v.alarms.select("id", numeric.prob_to_level(p).alias("level"), numeric.percent_rounded(p).alias("percent"))


def region_display_name(v: Lenses) -> DataFrame:
    raw = F.concat(F.lower("region_city"), F.lit("_"), F.upper("alert_type"))
    return v.alarms.select("id", text.region_display_name(raw).alias("display"))


def hhmm_since(v: Lenses) -> DataFrame:
    return v.alerts.select(F.col("pos").alias("id"), text.hhmm(F.col("started_at")).alias("since"))


def clamp_range(v: Lenses) -> DataFrame:
    start = F.date_add(F.to_date("start"), -(F.col("id") % 900).cast("int"))
    end = F.date_add(F.to_date("start"), (F.col("id") % 60 - 30).cast("int"))
    bounds = calendar.clamp_range(start, F.when(F.col("id") % 13 != 0, end), F.lit("2024-01-20").cast("date"))
    out = v.alarms.select("id", *[c.alias(n) for n, c in bounds.items()])
    return out.select("id", day_text("range_start").alias("range_start"), day_text("range_end").alias("range_end"), F.col("valid").cast("int").alias("valid"))


def alarms_with_region(v: Lenses) -> DataFrame:
    return named(v).select("id", "region_id", "region_city", "center_city_en", "center_city_ua")


def describe(v: Lenses) -> DataFrame:
    minutes = ops.with_duration(v.alarms)
    out = profile.describe(minutes, ["id", "region_id", "all_region", "duration_minutes"])
    return round_columns(out, "mean", "std", "min", "q1", "median", "q3", "max")


DESCRIBE_CELLS = """
    SELECT unnest(['id', 'region_id', 'all_region', 'duration_minutes']) AS col,
           unnest([CAST(id AS DOUBLE), region_id, all_region, (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0]) AS v
    FROM alarms"""


def counts_by_region(v: Lenses) -> DataFrame:
    return ops.counts_by_region(named(v)).orderBy("alarms", "center_city_ua")


def head(v: Lenses) -> DataFrame:
    return profile.head(v.alarms, ["start", "id"]).select("id", "region_id", stamp("start").alias("start_ts"))


def monthly_trend(v: Lenses) -> DataFrame:
    return round_columns(ops.monthly_trend(ops.counts_by_month(v.orders)), "rolling_mean")


def daily_histogram(v: Lenses) -> DataFrame:
    return round_columns(ops.daily_histogram(ops.counts_by_day(v.orders)), "bin_start", "bin_end")


def daily_kde(v: Lenses) -> DataFrame:
    return round_columns(ops.daily_kde(ops.counts_by_day(v.orders)), "x", "density")


def duration_box(v: Lenses) -> DataFrame:
    out = ops.duration_box(v.alarms)
    return round_columns(out, "q1", "median", "q3", "whisker_low", "whisker_high", "min", "max")


def region_consistency(v: Lenses) -> DataFrame:
    """Names swapped for some alarms, as in a shuffled dimension."""
    swapped = F.when(F.col("id") % 100 == 0, F.concat("region_city", F.lit("_old"))).otherwise(F.col("region_city"))
    return ops.region_consistency(v.alarms.withColumn("region_city", swapped), v.regions)


def text_anomalies(v: Lenses) -> DataFrame:
    found = ops.text_anomalies(v.table("documents").select("text", "source", "lang"), ["test", "fake", "bonus", "com"])
    return found.select("column", F.md5(F.col("value").cast("binary")).alias("value_md5"), "word")


def top_bottom_regions(v: Lenses) -> DataFrame:
    return ops.top_bottom_regions(ops.counts_by_region(named(v)))


HOURS = range(24)
DAYS = range(1, 32)

QUERIES = {
    "calendar_parts": (calendar_parts, with_views("""
        SELECT id, CAST(hour(start_ts) AS INT) AS hour, CAST(isodow(start_ts) - 1 AS INT) AS day_of_week,
               CAST(month(start_ts) AS INT) AS month, CAST(year(start_ts) AS INT) AS year, CAST(day(start_ts) AS INT) AS day,
               strftime(start_ts, '%Y-%m-%d') AS date_only, strftime(start_ts, '%Y-%m') AS year_month
        FROM alarms""", "alarms")),
    "duration_minutes": (duration_minutes, with_views("""
        SELECT id, round((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000.0, 6) + 0.0 AS duration_minutes,
               CAST(end_ts > start_ts AS INT) AS valid
        FROM alarms""", "alarms")),
    "probability_bands": (probability_bands, with_views("""
        SELECT id, CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.4 THEN 'medium'
                        WHEN p >= 0.2 THEN 'low' ELSE 'safe' END AS level,
               CAST(floor(p * 100 + 0.5) AS BIGINT) AS percent
        FROM (SELECT id, abs(sin(id * 1.0)) AS p FROM alarms)""", "alarms")),
    "region_display_name": (region_display_name, with_views("""
        SELECT id, replace(concat(upper(substr(r, 1, 1)), lower(substr(r, 2))), '_', ' ') AS display
        FROM (SELECT id, concat(lower(region_city), '_', upper(alert_type)) AS r FROM alarms)""", "alarms")),
    "hhmm_since": (hhmm_since, with_views("""
        SELECT pos AS id, CASE WHEN length(started_at) > 16 THEN substr(started_at, 12, 5) ELSE started_at END AS since
        FROM alerts""", "alerts")),
    "clamp_range": (clamp_range, with_views("""
        SELECT id, strftime(lo, '%Y-%m-%d') AS range_start, strftime(hi, '%Y-%m-%d') AS range_end,
               CAST(NOT coalesce(s > e, false) AND lo <= DATE '2024-01-20' AND lo <= hi AS INT) AS valid
        FROM (SELECT id, s, e, greatest(s, DATE '2022-02-24') AS lo,
                     least(coalesce(e, DATE '2024-01-20'), DATE '2024-01-20') AS hi
              FROM (SELECT id, CAST(start_ts AS DATE) - CAST(id % 900 AS INT) AS s,
                           CASE WHEN id % 13 <> 0 THEN CAST(start_ts AS DATE) + CAST(id % 60 - 30 AS INT) END AS e
                    FROM alarms))""", "alarms")),
    "alarms_with_region": (alarms_with_region, with_views(
        "SELECT id, region_id, region_city, center_city_en, center_city_ua FROM named_alarms", "named_alarms")),
    "describe": (describe, with_views("""
        SELECT col AS "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
               round(min(v), 6) + 0.0 AS min, round(quantile_cont(v, 0.25), 6) + 0.0 AS q1,
               round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.75), 6) + 0.0 AS q3,
               round(max(v), 6) + 0.0 AS max
        FROM cells GROUP BY 1""", "alarms", extra={"cells": DESCRIBE_CELLS})),
    "missing_profile": (lambda v: profile.missing_profile(alarm_profile_input(v)), with_views("""
        SELECT col AS "column", sum(CAST(m AS BIGINT))::BIGINT AS missing, round(sum(CAST(m AS INT)) * 100.0 / count(*), 2) AS missing_pct
        FROM (SELECT unnest(['alert_type', 'region_id', 'all_region', 'hour']) AS col,
                     unnest([alert_type IS NULL, region_id IS NULL, all_region IS NULL, hour IS NULL]) AS m FROM p)
        GROUP BY 1""", "alarms", extra={"p": PROFILE_SQL})),
    "column_profile": (lambda v: profile.column_profile(alarm_profile_input(v)), with_views("""
        SELECT u.col AS "column", u.type AS type, u.n AS non_null, rows, 4 AS columns
        FROM (SELECT count(*) AS rows, unnest([
                {'col': 'alert_type', 'type': 'string', 'n': count(alert_type)},
                {'col': 'region_id', 'type': 'int', 'n': count(region_id)},
                {'col': 'all_region', 'type': 'int', 'n': count(all_region)},
                {'col': 'hour', 'type': 'int', 'n': count(hour)}]) AS u
              FROM p)""", "alarms", extra={"p": PROFILE_SQL})),
    "duplicate_count": (lambda v: profile.duplicate_count(alarm_profile_input(v)), with_views("""
        SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM p GROUP BY ALL)
        """.replace("SELECT count(*) AS n FROM p GROUP BY ALL",
                    "SELECT alert_type, region_id, all_region, hour, count(*) AS n FROM p GROUP BY 1, 2, 3, 4"),
        "alarms", extra={"p": PROFILE_SQL})),
    "drop_duplicates": (lambda v: profile.drop_duplicates(alarm_profile_input(v)), with_views(
        "SELECT DISTINCT * FROM p", "alarms", extra={"p": PROFILE_SQL})),
    "counts_by_region": (counts_by_region, with_views(
        "SELECT center_city_ua, count(*) AS alarms FROM named_alarms GROUP BY 1", "named_alarms")),
    "counts_by_hour": (lambda v: ops.counts_by_hour(v.alarms), with_views(
        "SELECT CAST(hour(start_ts) AS INT) AS hour, count(*) AS alarms FROM alarms GROUP BY 1", "alarms")),
    "counts_by_weekday": (lambda v: ops.counts_by_weekday(v.alarms), with_views("""
        SELECT CAST(isodow(start_ts) - 1 AS INT) AS day_of_week, dayname(start_ts) AS day_name, count(*) AS alarms
        FROM alarms GROUP BY 1, 2""", "alarms")),
    "counts_by_month": (lambda v: ops.counts_by_month(v.orders), with_views(
        "SELECT strftime(start_ts, '%Y-%m') AS year_month, count(*) AS alarms FROM order_starts GROUP BY 1", "order_starts")),
    "counts_by_day": (lambda v: ops.counts_by_day(v.alarms).withColumn("date_only", day_text("date_only")), with_views(
        "SELECT strftime(start_ts, '%Y-%m-%d') AS date_only, count(*) AS alarms FROM alarms GROUP BY 1", "alarms")),
    "daily_summary": (
        lambda v: round_columns(ops.daily_summary(ops.counts_by_day(v.alarms)), "mean_per_day"),
        with_views("SELECT round(avg(n), 6) AS mean_per_day, max(n) AS max_per_day FROM daily", "alarms", extra=DAILY)),
    "region_hour_crosstab": (lambda v: ops.region_hour_crosstab(named(v)), with_views(
        "SELECT center_city_ua, "
        + ", ".join(f"count(*) FILTER (hour(start_ts) = {h}) AS h{h:02d}" for h in HOURS)
        + " FROM named_alarms GROUP BY 1", "named_alarms")),
    "calendar_matrix": (lambda v: ops.calendar_matrix(ops.counts_by_day(v.orders), 1996), with_views(
        "SELECT CAST(month(d) AS INT) AS month, "
        + ", ".join(f"CAST(sum(n) FILTER (day(d) = {x}) AS BIGINT) AS d{x:02d}" for x in DAYS)
        + " FROM daily WHERE year(d) = 1996 GROUP BY 1", "order_starts", extra=ORDER_DAILY)),
    "daily_histogram": (daily_histogram, with_views("""
        SELECT bin, count(*) AS days, round(lo + bin * (hi - lo) / 50, 6) AS bin_start,
               round(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_end
        FROM (SELECT lo, hi, CAST(least(floor((n - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin
              FROM daily, (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi FROM daily))
        GROUP BY bin, lo, hi""", "order_starts", extra=ORDER_DAILY)),
    "daily_kde": (daily_kde, with_views("""
        SELECT CAST(point AS INT) AS point, round(x, 6) AS x,
               round(sum(exp(-pow((x - n) / w, 2) / 2)) / (max(c) * max(w) * sqrt(2 * pi())), 6) AS density
        FROM (SELECT point, n, c, w, lo + point * (hi - lo) / 199.0 AS x
              FROM daily,
                   (SELECT count(*) AS c, stddev_samp(n) * pow(count(*), -0.2) AS w, min(n) AS lo, max(n) AS hi FROM daily),
                   (SELECT unnest(range(0, 200)) AS point))
        GROUP BY point, x""", "order_starts", extra=ORDER_DAILY)),
    "duration_box": (duration_box, with_views("""
        SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
               round(min(m) FILTER (m >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
               round(max(m) FILTER (m <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
               count(*) AS n, count(*) FILTER (m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1)) AS outliers,
               round(min(m), 6) AS min, round(max(m), 6) AS max
        FROM durations, (SELECT quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.75) AS q3
                         FROM durations)
        GROUP BY q1, median, q3""", "alarms", extra=DURATIONS)),
    "duration_summary": (
        lambda v: round_columns(ops.duration_summary(v.alarms), "median_minutes", "max_hours"),
        with_views("SELECT round(median(m), 6) AS median_minutes, round(max(m) / 60, 6) AS max_hours FROM durations",
                   "alarms", extra=DURATIONS)),
    "monthly_trend": (monthly_trend, with_views("""
        SELECT year_month, alarms,
               CASE WHEN count(*) OVER w = 3 THEN round(avg(alarms) OVER w, 6) END AS rolling_mean
        FROM (SELECT strftime(start_ts, '%Y-%m') AS year_month, count(*) AS alarms FROM order_starts GROUP BY 1)
        WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "order_starts")),
    "top_regions": (lambda v: ops.top_regions(ops.counts_by_region(named(v))), with_views("""
        SELECT center_city_ua, count(*) AS alarms FROM named_alarms GROUP BY 1
        ORDER BY alarms DESC, center_city_ua LIMIT 10""", "named_alarms")),
    "top_bottom_regions": (top_bottom_regions, with_views("""
        SELECT * FROM (SELECT center_city_ua, alarms, 'top' AS side FROM c ORDER BY alarms DESC, center_city_ua LIMIT 5)
        UNION ALL
        SELECT * FROM (SELECT center_city_ua, alarms, 'bottom' AS side FROM c ORDER BY alarms, center_city_ua DESC LIMIT 5)""",
        "named_alarms", extra={"c": "SELECT center_city_ua, count(*) AS alarms FROM named_alarms GROUP BY 1"})),
    "top_days": (lambda v: ops.top_days(ops.counts_by_day(v.orders)).withColumn("date_only", day_text("date_only")), with_views(
        "SELECT strftime(d, '%Y-%m-%d') AS date_only, n AS alarms FROM daily ORDER BY n DESC, d LIMIT 10",
        "order_starts", extra=ORDER_DAILY)),
    "known_events_check": (
        lambda v: ops.known_events_check(ops.counts_by_day(v.alarms), ["2024-01-05", "2024-01-17", "2022-02-24", "2024-07-08"])
        .select(day_text("date_only").alias("date_only"), "alarms", F.col("zero").cast("int").alias("zero")),
        with_views("""
        SELECT strftime(k, '%Y-%m-%d') AS date_only, coalesce(n, 0) AS alarms, CAST(coalesce(n, 0) = 0 AS INT) AS zero
        FROM (SELECT unnest([DATE '2024-01-05', DATE '2024-01-17', DATE '2022-02-24', DATE '2024-07-08']) AS k)
        LEFT JOIN daily ON d = k""", "alarms", extra=DAILY)),
    "head": (head, with_views(
        "SELECT id, region_id, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts FROM alarms ORDER BY alarms.start_ts, id LIMIT 5",
        "alarms")),
    "date_bound_anomalies": (lambda v: ops.date_bound_anomalies(v.alarms, "2024-01-03", "2024-01-29"), with_views("""
        SELECT count(*) FILTER (start_ts < TIMESTAMP '2024-01-03') AS too_early,
               count(*) FILTER (start_ts > TIMESTAMP '2024-01-29') AS too_late FROM alarms""", "alarms")),
    "distinct_years": (lambda v: ops.distinct_years(v.orders, "start"), with_views(
        "SELECT DISTINCT CAST(year(start_ts) AS INT) AS year FROM order_starts", "order_starts")),
    "region_consistency": (region_consistency, with_views("""
        SELECT region_id, city AS region_city, center_city_en, count(*) AS alarms
        FROM (SELECT *, CASE WHEN id % 100 = 0 THEN concat(region_city, '_old') ELSE region_city END AS city FROM named_alarms)
        WHERE city IS DISTINCT FROM center_city_en GROUP BY 1, 2, 3""", "named_alarms")),
    "region_count_check": (
        lambda v: ops.region_count_check(v.regions).withColumn("as_expected", F.col("as_expected").cast("int")),
        with_views("SELECT count(*) AS regions, CAST(count(*) = 25 AS INT) AS as_expected FROM regions", "regions")),
    "text_anomalies": (text_anomalies, """
        SELECT DISTINCT col AS "column", md5(value) AS value_md5, word
        FROM (SELECT 'text' AS col, text AS value FROM documents UNION ALL SELECT 'source', source FROM documents
              UNION ALL SELECT 'lang', lang FROM documents),
             (SELECT unnest(['test', 'fake', 'bonus', 'com']) AS word)
        WHERE contains(lower(value), word)"""),
    "impossible_intervals": (lambda v: ops.impossible_intervals(v.alarms), with_views("""
        SELECT count(*) FILTER (end_ts < start_ts) AS end_before_start, count(*) FILTER (end_ts < start_ts) AS negative_duration,
               count(*) FILTER (end_ts = start_ts) AS zero_duration,
               count(*) FILTER (end_ts > start_ts + INTERVAL 100 HOUR) AS too_long
        FROM alarms""", "alarms")),
}
