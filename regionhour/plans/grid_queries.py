"""Registered queries over the region-hour grid, the serving tables and the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.constants import ALARM_UPPER_BOUND, FIRST_DAY, HORIZONS, MAX_ALARM_HOURS, RANGES
from regionhour.operators import grid as ops
from regionhour.operators import reports, serving, weather
from regionhour.plans import jobs
from regionhour.plans.alarm_queries import round_columns, stamp
from regionhour.plans.lenses import Lenses, with_views
from regionhour.plans.report_queries import ARTICLE, LEXICON, daily_scores, plain_text
from regionhour.plans.weather_queries import READINGS

CUTOFF = "2024-01-22"
AT = "2024-01-22 13:30:00"
WEATHER_VALUES = ["hour_temp", "hour_visibility"]
REPORT_VALUES = ["page_length", "tokens", "score"]
TYPES = ["click", "error", "purchase", "signup", "view"]
ROUNDED = [*[f"prev_{c}" for c in WEATHER_VALUES], "prev_score"]


def span(alarms: DataFrame, end: str | None = None) -> tuple[Column, str | Column]:
    """From the hour of the first start to that of the last end, or to an earlier ``end``; alarms after that are not read for it."""
    first, last = ops.alarm_range(alarms.where(F.col("start") < F.lit(end).cast("timestamp")) if end else alarms)
    return first, end or last


def flags(v: Lenses, end: str | None = None, alarms: DataFrame | None = None) -> DataFrame:
    """The grid of every alarm, or of the given ones."""
    alarms = v.alarms if alarms is None else alarms
    return ops.region_hour_flags(alarms, v.regions, *span(alarms, end))


def interval_faults(v: Lenses) -> DataFrame:
    """How many alarms each rule keeps off the grid."""
    return ops.rejected_intervals(v.intervals).groupBy("reason").agg(F.count(F.lit(1)).alias("alarms"))


def labels(v: Lenses, end: str | None = None, alarms: DataFrame | None = None) -> DataFrame:
    return ops.horizon_labels(flags(v, end, alarms), span(v.alarms if alarms is None else alarms, end)[1])


def forecast(v: Lenses) -> DataFrame:
    return serving.base_rate_forecast(labels(v, CUTOFF))


def sound_forecast(v: Lenses) -> DataFrame:
    """The forecast from alarms without a fault, which the queries of the current state show."""
    return serving.base_rate_forecast(labels(v, CUTOFF, ops.sound_intervals(v.intervals)))


def day_features(v: Lenses) -> DataFrame:
    """One row per report day: page length, words of its text and their score."""
    scores = reports.escalation_score(reports.tokenize_daily(plain_text(v)), LEXICON).select("report_date", "tokens", "score")
    return v.reports.select("report_date", F.length("html").alias("page_length")).join(scores, "report_date", "left")


def hourly(v: Lenses) -> DataFrame:
    return ops.hourly_weather(weather.weather_range_filter(v.weather, READINGS), WEATHER_VALUES)


def lagged(v: Lenses) -> DataFrame:
    return ops.lagged_features(flags(v), hourly(v), day_features(v), WEATHER_VALUES, REPORT_VALUES)


def hour_stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("hour_ts", stamp("hour_ts"))


def feature_table(v: Lenses) -> DataFrame:
    out = jobs.feature_table(
        v.alarms, v.regions, v.weather, day_features(v), *span(v.alarms), READINGS, WEATHER_VALUES, REPORT_VALUES
    )
    return round_columns(hour_stamp(out), *ROUNDED)


def split_sizes(v: Lenses) -> DataFrame:
    train, test = ops.chronological_split(flags(v), CUTOFF)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_alarm").alias("alarms"), stamp(F.min("hour_ts")).alias("first_hour"),
        stamp(F.max("hour_ts")).alias("last_hour"),
    )


def prediction(v: Lenses) -> DataFrame:
    out = serving.prediction(sound_forecast(v), serving.threat_mix(v.intervals, CUTOFF), v.regions, AT)
    kinds = F.explode(F.map_entries("threat_types")).alias("kind")
    names = [f"probability_{h}h" for h in HORIZONS]
    flat = out.select("region_id", F.col("center_city_en").alias("region_name"), "threat_level", *names, "updated_at", kinds)
    return round_columns(
        flat.select("region_id", "region_name", "threat_level", *names, "updated_at", F.col("kind.key").alias("type"),
                    F.col("kind.value").alias("share")),
        *names, "share",
    )


def overlay(v: Lenses) -> DataFrame:
    """Active regions at a moment over all regions."""
    active = serving.active_at(v.intervals, AT).groupBy("region_id").agg(
        F.lit(True).alias("active"), F.lit("high").alias("threat_level")
    )
    out = serving.overlay_region_status(v.regions.select("region_id", "center_city_en"), active)
    return out.withColumn("active", F.col("active").cast("int"))


def region_crosswalk(v: Lenses) -> DataFrame:
    """Alarm region names against a crosswalk that knows some of them."""
    pairs = {"NATION_1": "one", "NATION_2": "two", "NATION_11": "eleven"}
    out = serving.region_crosswalk(v.alarms.select("id", F.col("region_city").alias("name")), serving.crosswalk(v.spark, pairs))
    return out.select("id", "name", "region")


def current_alarms(v: Lenses) -> DataFrame:
    out = serving.current_alarms(v.intervals, v.regions, sound_forecast(v), AT)
    return out.withColumns({"active": F.col("active").cast("int"), "since": stamp("since")})


def first_alerts(v: Lenses) -> DataFrame:
    return serving.first_alert_per_region(v.alerts, "snapshot")


# --- the same rules in SQL --------------------------------------------------

_FAULT = f"""
    (CASE WHEN start_ts IS NULL OR end_ts IS NULL THEN 'no start or end' WHEN start_ts < TIMESTAMP '{FIRST_DAY}' THEN 'too early'
          WHEN start_ts > TIMESTAMP '{ALARM_UPPER_BOUND}' THEN 'too late' WHEN end_ts < start_ts THEN 'end before start'
          WHEN end_ts - start_ts > INTERVAL {MAX_ALARM_HOURS} HOUR THEN 'too long' END)"""


def grid_views(end: str | None = None, alarms: str = "alarms") -> dict[str, str]:
    """Views of the grid; ``alarms`` names the view its alarms come from."""
    hour = "INTERVAL 1 HOUR"
    stop = f"TIMESTAMP '{end}'" if end else "stop"
    overlap = "a.region_id = g.region_id AND a.start_ts < g.hour_ts + INTERVAL 1 HOUR AND a.end_ts > g.hour_ts AND a.end_ts > a.start_ts"
    return {
        "bounds": f"""
            SELECT date_trunc('hour', min(start_ts)) AS first_hour,
                   greatest(date_trunc('hour', max(end_ts) - INTERVAL 1 MICROSECOND), date_trunc('hour', min(start_ts))) + {hour} AS stop
            FROM {alarms}""",
        "hours": f"SELECT unnest(range(first_hour, {stop}, {hour})) AS hour_ts FROM bounds",
        "g": "SELECT region_id, hour_ts FROM regions, hours",
        "flags": f"""
            SELECT g.region_id, g.hour_ts, CAST(count(a.id) > 0 AS INT) AS is_alarm
            FROM g LEFT JOIN {alarms} a ON {overlap} GROUP BY 1, 2""",
        "labels": "SELECT region_id, hour_ts, is_alarm, " + ", ".join(
            f"CASE WHEN count(*) OVER (PARTITION BY region_id ORDER BY hour_ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} "
            f"THEN max(is_alarm) OVER (PARTITION BY region_id ORDER BY hour_ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS alarm_next_{h}h"
            for h in HORIZONS) + " FROM flags",
    }


_FORECAST = {
    "forecast": "SELECT region_id, CAST(hour(hour_ts) AS INT) AS hour, "
    + ", ".join(f"avg(alarm_next_{h}h) AS probability_{h}h" for h in HORIZONS) + " FROM labels GROUP BY 1, 2",
    "mix": f"""
        SELECT region_id, alert_type, n / sum(n) OVER (PARTITION BY region_id) AS share
        FROM (SELECT region_id, alert_type, count(*) AS n FROM alarms WHERE start_ts < TIMESTAMP '{CUTOFF}' GROUP BY 1, 2)""",
}
FORECAST_VIEWS = {**grid_views(CUTOFF), **_FORECAST}
SOUND_FORECAST_VIEWS = {"sound": f"SELECT * FROM alarms WHERE {_FAULT} IS NULL", **grid_views(CUTOFF, "sound"), **_FORECAST}
_IN_RANGE = " AND ".join(f"coalesce({c} BETWEEN {RANGES[f][0]} AND {RANGES[f][1]}, true)" for f, c in READINGS.items())
LAG_VIEWS = {
    **grid_views(),
    "hourly": f"SELECT region_id, hour_ts, avg(hour_temp) AS hour_temp, avg(hour_visibility) AS hour_visibility FROM weather WHERE {_IN_RANGE} GROUP BY 1, 2",
    "article": ARTICLE,
    "tokens": "SELECT report_date, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM article",
    "scored": daily_scores("tokens"),
    "lagged": """
        SELECT f.region_id, f.hour_ts, f.is_alarm, round(w.hour_temp, 6) + 0.0 AS prev_hour_temp,
               round(w.hour_visibility, 6) + 0.0 AS prev_hour_visibility, CAST(length(r.html) AS INT) AS prev_page_length,
               s.tokens AS prev_tokens, s.score AS prev_score
        FROM flags f LEFT JOIN hourly w ON w.region_id = f.region_id AND w.hour_ts = f.hour_ts - INTERVAL 1 HOUR
        LEFT JOIN reports r ON r.report_date = CAST(f.hour_ts AS DATE) - 1 LEFT JOIN scored s ON s.report_date = r.report_date""",
}
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_LEVEL = """
    CASE WHEN probability_1h >= 0.8 THEN 'critical' WHEN probability_1h >= 0.6 THEN 'high' WHEN probability_1h >= 0.4 THEN 'medium'
         WHEN probability_1h >= 0.2 THEN 'low' ELSE 'safe' END"""
_PROBABILITIES = ", ".join(f"round(probability_{h}h, 6) + 0.0 AS probability_{h}h" for h in HORIZONS)
_FIRST_ALERTS = """
    SELECT snapshot, location_oblast, coalesce(a.alert_type, 'unknown') AS type,
           CASE WHEN length(a.started_at) > 16 THEN substr(a.started_at, 12, 5) ELSE a.started_at END AS since
    FROM (SELECT snapshot, location_oblast, min(struct_pack(pos := pos, alert_type := alert_type, started_at := started_at)) AS a
          FROM alerts WHERE coalesce(location_oblast, '') <> '' GROUP BY 1, 2)"""
_ACTIVE = f"start_ts <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < end_ts"
_DAY = f"TIMESTAMP '{AT[:10]}'"

QUERIES = {
    "region_hour_flags": (lambda v: hour_stamp(flags(v)), with_views(
        f"SELECT region_id, {_STAMP.format('hour_ts')} AS hour_ts, is_alarm FROM flags", "alarms", "regions", extra=grid_views())),
    "horizon_labels": (lambda v: hour_stamp(labels(v)), with_views(
        f"SELECT * REPLACE ({_STAMP.format('hour_ts')} AS hour_ts) FROM labels", "alarms", "regions", extra=grid_views())),
    "interval_faults": (interval_faults, with_views(f"""
        SELECT reason, count(*) AS alarms FROM (SELECT {_FAULT} AS reason FROM alarms) WHERE reason IS NOT NULL GROUP BY 1""", "alarms")),
    "lagged_features": (
        lambda v: round_columns(hour_stamp(lagged(v)), *ROUNDED),
        with_views(f"SELECT * REPLACE ({_STAMP.format('hour_ts')} AS hour_ts) FROM lagged",
                   "alarms", "regions", "weather", "reports", extra=LAG_VIEWS)),
    "chronological_split": (split_sizes, with_views(f"""
        SELECT CASE WHEN hour_ts < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS part, count(*) AS n,
               CAST(sum(is_alarm) AS BIGINT) AS alarms, {_STAMP.format('min(hour_ts)')} AS first_hour, {_STAMP.format('max(hour_ts)')} AS last_hour
        FROM flags GROUP BY 1""", "alarms", "regions", extra=grid_views())),
    "feature_table": (feature_table, with_views(f"""
        SELECT {_STAMP.format('hour_ts')} AS hour_ts, region_id, l.is_alarm, {", ".join(f"alarm_next_{h}h" for h in HORIZONS)},
               prev_hour_temp, prev_hour_visibility, prev_page_length, prev_tokens, prev_score
        FROM lagged JOIN labels l USING (region_id, hour_ts)""", "alarms", "regions", "weather", "reports", extra=LAG_VIEWS)),
    "base_rate_forecast": (
        lambda v: round_columns(forecast(v), *[f"probability_{h}h" for h in HORIZONS]),
        with_views(f"SELECT region_id, hour, {_PROBABILITIES} FROM forecast", "alarms", "regions", extra=FORECAST_VIEWS)),
    "threat_mix": (
        lambda v: round_columns(serving.threat_mix(v.intervals, CUTOFF), "share"),
        with_views("SELECT region_id, alert_type, round(share, 6) AS share FROM mix", "alarms", "regions", extra=SOUND_FORECAST_VIEWS)),
    "prediction": (prediction, with_views(f"""
        SELECT region_id, center_city_en AS region_name, {_LEVEL} AS threat_level, {_PROBABILITIES}, '{AT}' AS updated_at,
               alert_type AS type, round(share, 6) AS share
        FROM forecast JOIN mix USING (region_id) JOIN regions USING (region_id) WHERE hour = {int(AT[11:13])}""",
        "alarms", "regions", extra=SOUND_FORECAST_VIEWS)),
    "timeline": (
        lambda v: round_columns(serving.timeline(forecast(v), serving.threat_mix(v.intervals, CUTOFF), TYPES), "probability", *TYPES),
        with_views("""
        SELECT region_id, concat(lpad(CAST(hour AS VARCHAR), 2, '0'), ':00') AS hour, round(probability_1h, 6) + 0.0 AS probability, """
        + ", ".join(f"round(probability_1h * coalesce(max(share) FILTER (alert_type = '{t}'), 0), 6) + 0.0 AS {t}" for t in TYPES)
        + " FROM forecast LEFT JOIN mix USING (region_id) WHERE hour % 2 = 0 GROUP BY region_id, hour, probability_1h",
        "alarms", "regions", extra=FORECAST_VIEWS)),
    "current_alarms": (current_alarms, with_views(f"""
        SELECT region_id, center_city_en AS name, coalesce({_LEVEL}, 'safe') AS threat_level, CAST(a.id IS NOT NULL AS INT) AS active,
               a.alert_type AS type, {_STAMP.format('a.start_ts')} AS since
        FROM regions LEFT JOIN (SELECT * FROM forecast WHERE hour = {int(AT[11:13])}) USING (region_id)
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY start_ts, id) AS rn FROM alarms WHERE {_ACTIVE})
                   WHERE rn = 1) a USING (region_id)""", "alarms", "regions", extra=SOUND_FORECAST_VIEWS)),
    "overlay_region_status": (overlay, with_views(f"""
        SELECT region_id, center_city_en, CAST(a.region_id IS NOT NULL AS INT) AS active,
               CASE WHEN a.region_id IS NULL THEN 'safe' ELSE 'high' END AS threat_level
        FROM regions LEFT JOIN (SELECT DISTINCT region_id FROM alarms WHERE {_ACTIVE}) a USING (region_id)""", "alarms", "regions")),
    "region_crosswalk": (region_crosswalk, with_views("""
        SELECT id, region_city AS name, CASE region_city WHEN 'NATION_1' THEN 'one' WHEN 'NATION_2' THEN 'two'
               WHEN 'NATION_11' THEN 'eleven' ELSE region_city END AS region FROM alarms""", "alarms")),
    "alarms_today_stats": (
        lambda v: round_columns(serving.alarms_today_stats(v.intervals, v.regions, sound_forecast(v), AT), "avg_threat_level", "total_duration_today_hours"),
        with_views(f"""
        SELECT (SELECT count(DISTINCT region_id) FROM alarms WHERE {_ACTIVE}) AS active_alarms_count,
               (SELECT count(*) FROM regions) AS total_regions,
               (SELECT round(avg(coalesce(probability_1h, 0)) * 10, 6) FROM regions LEFT JOIN now USING (region_id)) AS avg_threat_level,
               (SELECT center_city_en FROM regions LEFT JOIN now USING (region_id)
                ORDER BY coalesce(probability_1h, 0) DESC, center_city_en LIMIT 1) AS most_threatened_region,
               (SELECT count(*) FROM alarms WHERE start_ts >= {_DAY} AND start_ts < {_DAY} + INTERVAL 1 DAY) AS total_alarms_today,
               (SELECT round(sum(epoch_us(least(end_ts, {_DAY} + INTERVAL 1 DAY)) - epoch_us(greatest(start_ts, {_DAY}))) / 3600000000.0, 6)
                FROM alarms WHERE end_ts > start_ts AND start_ts < {_DAY} + INTERVAL 1 DAY AND end_ts > {_DAY}) AS total_duration_today_hours""",
        "alarms", "regions", extra={**SOUND_FORECAST_VIEWS, "now": f"SELECT * FROM forecast WHERE hour = {int(AT[11:13])}"})),
    "first_alert_per_region": (first_alerts, with_views(_FIRST_ALERTS, "alerts")),
    "active_count": (
        lambda v: serving.active_count(first_alerts(v), "snapshot"),
        with_views("SELECT snapshot, count(*) AS active_count FROM f GROUP BY 1", "alerts", extra={"f": _FIRST_ALERTS})),
}
