"""Registered queries over hourly weather and its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionhour.constants import RANGES, REQUIRED_HOURLY, WEATHER_MAIN
from regionhour.functions import calendar, numeric, text
from regionhour.operators import profile, quality
from regionhour.operators import weather as ops
from regionhour.plans import jobs
from regionhour.plans.alarm_queries import day_text, named, r6, round_columns, stamp
from regionhour.plans.lenses import Lenses, with_views

READINGS = {
    "temp": "hour_temp", "humidity": "hour_humidity", "windspeed": "hour_windspeed",
    "pressure": "hour_pressure", "cloudcover": "hour_cloudcover", "visibility": "hour_visibility",
}
NOW_FIELDS = ["hour_temp", "hour_humidity", "hour_windspeed", "hour_winddir", "hour_visibility",
              "hour_cloudcover", "hour_pressure", "hour_precip", "hour_conditions"]


def keyed(v: Lenses) -> tuple[DataFrame, DataFrame]:
    return ops.alarm_keys(named(v)), ops.weather_keys(v.weather)


def weather_timestamp(v: Lenses) -> DataFrame:
    parsed = calendar.weather_timestamp(v.weather.select("line_no", "hour_temp", "day_datetime", "hour_datetime"))
    return parsed.select("line_no", r6("hour_temp").alias("hour_temp"), day_text("day_date").alias("day_date"), "hour")


def drop_incomplete_keys(v: Lenses) -> DataFrame:
    counted = ops.weather_keys(v.weather).groupBy(*ops.KEY).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("day_date", day_text("day_date"))


def safe_double(v: Lenses) -> DataFrame:
    raw = (
        F.when(F.col("line_no") % 5 == 0, F.concat(F.lit(" "), "hour_temp", F.lit(" ")))
        .when(F.col("line_no") % 7 == 0, "   ").otherwise(F.col("hour_temp"))
    )
    return v.weather_text.select("line_no", numeric.safe_double(raw).alias("value"), numeric.safe_double(F.col("hour_pressure")).alias("pressure"))


def flatten_forecast(v: Lenses) -> DataFrame:
    every = ops.flatten_forecast(v.forecast_api).withColumn("kept", F.lit("all"))
    first = ops.flatten_forecast(v.forecast_api, first_day_only=True).withColumn("kept", F.lit("first"))
    return round_columns(every.unionByName(first), "temp", "humidity", "windspeed", "winddir")


_FLAT = """
    SELECT l_orderkey * 8 + l_linenumber AS line_no, CAST(l_suppkey % 25 AS INT) + 1 AS region_id,
           strftime(l_shipdate, '%Y-%m-%d_%H') AS request_hour,
           concat(lpad(CAST((l_partkey + step) % 24 AS VARCHAR), 2, '0'), ':00:00') AS datetime,
           round(l_quantity + step, 6) AS temp, round(l_discount * 1100, 6) AS humidity, round(l_tax * 2600, 6) AS windspeed,
           round(l_quantity * 7.5, 6) AS winddir, CASE WHEN l_linenumber % 2 <> 0 THEN l_quantity END AS visibility,
           l_quantity * 2 AS cloudcover, CAST(860 + l_linenumber * 35 AS DOUBLE) AS pressure, CAST(0.0 AS DOUBLE) AS precip,
           l_returnflag AS conditions, step
    FROM lineitem, (SELECT unnest([0, 1, 2]) AS step)"""


def alarms_with_weather(v: Lenses) -> DataFrame:
    alarms, weather = keyed(v)
    needed = ops.weather_at_alarms(weather.select(*ops.KEY, "line_no", "hour_temp", "hour_visibility"), alarms)
    joined = ops.alarms_with_weather(alarms, ops.one_per_hour(needed, "line_no", "hour_temp", "hour_visibility"))
    return joined.select("id", "line_no", "join_city", stamp("start").alias("start_ts"), r6("hour_temp").alias("hour_temp"), "hour_visibility")


def alarm_start_flag(v: Lenses) -> DataFrame:
    alarms, weather = keyed(v)
    counted = ops.alarm_start_flag(weather, alarms).groupBy(*ops.KEY, "is_alarm").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("day_date", day_text("day_date"))


def correlation_matrix(v: Lenses) -> DataFrame:
    alarms, weather = keyed(v)
    flagged = ops.alarm_start_flag(weather, alarms)
    return round_columns(profile.correlation_matrix(flagged, CORRELATED), "corr")


CORRELATED = ["hour_temp", "hour_humidity", "hour_windspeed", "hour_visibility", "is_alarm"]
_KEY_MATCH = "w.join_city = a.join_city AND w.day_key = a.day_key AND w.hour_key = a.hour_key"
_FLAGGED = f"""
    SELECT w.*, CASE WHEN a.join_city IS NULL THEN 0 ELSE 1 END AS is_alarm
    FROM keyed_weather w LEFT JOIN (SELECT DISTINCT join_city, day_key, hour_key FROM keyed_alarms) a ON {_KEY_MATCH}"""
_BOX = """
    SELECT state, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, lo AS min, hi AS max,
           (SELECT min(x) FROM samples s WHERE s.state = b.state AND x >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
           (SELECT max(x) FROM samples s WHERE s.state = b.state AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
           (SELECT count(*) FROM samples s WHERE s.state = b.state
             AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS outliers
    FROM (SELECT state, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                 quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi FROM samples GROUP BY state) b"""
_SAMPLES = f"""
    SELECT 'during alarms' AS state, hour_visibility AS x FROM keyed_weather w JOIN keyed_alarms a ON {_KEY_MATCH}
    WHERE hour_visibility IS NOT NULL
    UNION ALL SELECT 'overall', hour_visibility FROM keyed_weather WHERE hour_visibility IS NOT NULL"""


def union_labeled(v: Lenses) -> DataFrame:
    """Both samples as counted values: the join of alarms and weather is not built."""
    hours = ops.value_hours(*keyed(v), F.col("hour_visibility"), "hour_visibility")
    during = hours.where("during > 0").select("hour_visibility", F.col("during").alias("n"))
    overall = hours.select("hour_visibility", F.col("overall").alias("n"))
    return profile.union_labeled(during, overall, ("during alarms", "overall"))


def forecast_quality(v: Lenses) -> DataFrame:
    hours = v.weather.select(
        "region_id", day_text("day_date").alias("day"), F.lit(True).alias("present"),
        *[F.col(c).alias(f) for f, c in READINGS.items()],
    )
    return quality.forecast_file_quality(hours, ["region_id", "day"])


def forecast_file_quality(v: Lenses) -> DataFrame:
    return quality.forecast_document_quality(v.forecasts, ["file"])


def _quality_sql(source: str, keys: str, n_keys: int, columns: dict[str, str], present: str) -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns.values())
    out = " + ".join(
        f"CAST(coalesce({columns[f]} < {lo} OR {columns[f]} > {hi}, false) AS INT)" for f, (lo, hi) in RANGES.items()
    )
    return f"""
        SELECT {keys}, count(*) FILTER ({present}) AS hours,
               CAST(coalesce(sum({nulls}) FILTER ({present}), 0) AS BIGINT) AS nulls,
               CAST(coalesce(sum({out}) FILTER ({present}), 0) AS BIGINT) AS out_of_range
        FROM {source} GROUP BY {", ".join(str(i + 1) for i in range(n_keys))}"""


FILE_QUALITY = _quality_sql("forecast_hours", "file", 1, {f: f for f in RANGES}, "step IS NOT NULL")
DAY_QUALITY = _quality_sql("weather", "region_id, strftime(day_date, '%Y-%m-%d') AS day", 2, READINGS, "true")
_VERDICT = """
    SELECT *, CAST(hours <> 24 AS INT) AS incomplete, CAST(hours = 24 AND nulls = 0 AND out_of_range = 0 AS INT) AS valid FROM q"""


def int_flags(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


def rows(v: Lenses) -> DataFrame:
    return quality.weather_rows(v.weather_text)


def nest_weather_days(v: Lenses) -> DataFrame:
    nested = quality.nest_weather_days(rows(v), quality.weather_day_table(rows(v)))
    hour = F.element_at
    return nested.select(
        "city", "date", F.col("daily.day_tempmax").alias("day_tempmax"), F.col("daily.latitude").alias("latitude"),
        F.size("hours").cast("long").alias("n_hours"),
        hour("hours", 1)["hour_datetime"].alias("first_hour"), hour("hours", -1)["hour_datetime"].alias("last_hour"),
    )


def weather_day_issues(v: Lenses) -> DataFrame:
    return jobs.weather_issues(v.weather_text)


def coverage(v: Lenses) -> DataFrame:
    return quality.city_coverage(quality.weather_day_table(rows(v)), calendar.text_date(F.col("date")))


def city_coverage(v: Lenses) -> DataFrame:
    out = coverage(v)
    return out.select("city", "days", "expected", r6("coverage").alias("coverage"), day_text("first_day").alias("first_day"), day_text("last_day").alias("last_day"))


def city_quality_status(v: Lenses) -> DataFrame:
    status, _ = jobs.weather_quality_job(v.weather_text)
    return int_flags(status.select("city", "days", "issues", "errors", "clean"), "clean")


# --- the same rules in SQL --------------------------------------------------

_ROWS = """
    SELECT *, trim(split_part(city_address, ',', 1)) AS city, day_datetime AS date
    FROM weather_text WHERE coalesce(day_datetime, '') <> '' AND trim(split_part(city_address, ',', 1)) <> ''"""
_DAY_ROWS = """
    SELECT city, date, f.day_tempmax AS day_tempmax, f.day_tempmin AS day_tempmin, f.lat AS latitude, f.lon AS longitude, n_hours
    FROM (SELECT city, date, count(*) FILTER (hour_datetime <> '') AS n_hours,
                 min(struct_pack(line_no := line_no, day_datetime := day_datetime, day_tempmax := day_tempmax,
                                 day_tempmin := day_tempmin, lat := city_latitude, lon := city_longitude)) AS f
          FROM r GROUP BY 1, 2)"""
_HOURS = """
    SELECT city, date, hour_datetime, x.day_tempmax, x.day_tempmin,
           TRY_CAST(nullif(trim(hour_temp), '') AS DOUBLE) AS t, TRY_CAST(x.day_tempmax AS DOUBLE) AS hi,
           TRY_CAST(x.day_tempmin AS DOUBLE) AS lo, r.hour_temp, hour_humidity, hour_windspeed, hour_pressure, hour_cloudcover
    FROM r JOIN x USING (city, date) WHERE hour_datetime <> ''"""
_ISSUES = """
    SELECT city, date, 'CHRONOLOGY' AS category, concat('Expected 24h, found ', n_hours, 'h') AS message FROM x WHERE n_hours <> 24
    UNION ALL SELECT city, date, 'GEOGRAPHY', concat('Lat ', CAST(latitude AS DOUBLE), ' outside Ukraine') FROM x
      WHERE CAST(latitude AS DOUBLE) <> 0 AND CAST(latitude AS DOUBLE) NOT BETWEEN 44 AND 53
    UNION ALL SELECT city, date, 'GEOGRAPHY', concat('Lon ', CAST(longitude AS DOUBLE), ' outside Ukraine') FROM x
      WHERE CAST(longitude AS DOUBLE) <> 0 AND CAST(longitude AS DOUBLE) NOT BETWEEN 22 AND 41
    UNION ALL SELECT city, date, 'CONSISTENCY', concat('Hour ', hour_datetime, ': ', t, ' > Day Max ', hi) FROM h WHERE t > hi + 0.5
    UNION ALL SELECT city, date, 'CONSISTENCY', concat('Hour ', hour_datetime, ': ', t, ' < Day Min ', lo) FROM h WHERE t < lo - 0.5
    """ + " ".join(f"""
    UNION ALL SELECT city, date, 'NULL', 'Empty {c}' FROM h WHERE TRY_CAST(nullif(trim({c}), '') AS DOUBLE) IS NULL
    UNION ALL SELECT city, date, 'RANGE', concat('{c}=', TRY_CAST({c} AS DOUBLE), ' out of {RANGES[c[5:]][0]}..{RANGES[c[5:]][1]}')
      FROM h WHERE TRY_CAST(nullif(trim({c}), '') AS DOUBLE) NOT BETWEEN {RANGES[c[5:]][0]} AND {RANGES[c[5:]][1]}"""
    for c in REQUIRED_HOURLY)
ISSUE_VIEWS = {"r": _ROWS, "x": _DAY_ROWS, "h": _HOURS, "issues": _ISSUES}
_COVERAGE = """
    SELECT city, count(*) AS days, datediff('day', min(CAST(date AS DATE)), max(CAST(date AS DATE))) + 1 AS expected,
           min(date) AS first_day, max(date) AS last_day FROM x GROUP BY 1"""
_ISSUE_ROWS = "SELECT city, date, concat(date, '.json') AS file, 'ERROR' AS severity, category, message FROM issues"

_RANGE_OK = " AND ".join(
    f"coalesce({c} BETWEEN {RANGES[f][0]} AND {RANGES[f][1]}, true)" for f, c in READINGS.items()
)

QUERIES = {
    "select_weather_main": (lambda v: round_columns(
        ops.select_weather_main(v.weather), "hour_temp", "hour_humidity", "hour_precip", "hour_windspeed", "hour_windgust"),
        with_views("SELECT " + ", ".join(
            f"round({c}, 6) + 0.0 AS {c}" if c in ("hour_temp", "hour_humidity", "hour_precip", "hour_windspeed", "hour_windgust") else c
            for c in WEATHER_MAIN) + " FROM weather", "weather")),
    "weather_timestamp": (weather_timestamp, with_views("""
        SELECT line_no, round(hour_temp, 6) + 0.0 AS hour_temp, strftime(d, '%Y-%m-%d') AS day_date, CAST(hour(t) AS INT) AS hour
        FROM (SELECT line_no, hour_temp, try_strptime(day_datetime, '%Y-%m-%d') AS d, try_strptime(hour_datetime, '%H:%M:%S') AS t
              FROM weather)""", "weather")),
    "city_key": (
        lambda v: v.weather.select(text.city_key(F.concat(F.lit("  "), "city_address")).alias("join_city")).groupBy("join_city")
        .agg(F.count(F.lit(1)).alias("n")),
        with_views("SELECT lower(trim(split_part(concat('  ', city_address), ',', 1))) AS join_city, count(*) AS n FROM weather GROUP BY 1", "weather")),
    "drop_incomplete_keys": (drop_incomplete_keys, with_views("""
        SELECT join_city, strftime(day_key, '%Y-%m-%d') AS day_date, hour_key AS hour, count(*) AS n
        FROM keyed_weather GROUP BY 1, 2, 3""", "keyed_weather")),
    "safe_double": (safe_double, with_views("""
        SELECT line_no, TRY_CAST(nullif(trim(CASE WHEN line_no % 5 = 0 THEN concat(' ', hour_temp, ' ')
                                                  WHEN line_no % 7 = 0 THEN '   ' ELSE hour_temp END), '') AS DOUBLE) AS value,
               TRY_CAST(hour_pressure AS DOUBLE) AS pressure
        FROM weather_text""", "weather_text")),
    "wind_compass": (
        lambda v: v.weather.select("line_no", r6("hour_winddir").alias("degrees"), numeric.wind_compass(F.col("hour_winddir")).alias("compass")),
        with_views("""
        SELECT line_no, round(hour_winddir, 6) AS degrees,
               ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(hour_winddir / 45 + 0.5) AS INT) % 8 + 1] AS compass
        FROM weather""", "weather")),
    "flatten_forecast": (flatten_forecast, f"""
        WITH flat AS ({_FLAT})
        SELECT * EXCLUDE (step), 'all' AS kept FROM flat UNION ALL SELECT * EXCLUDE (step), 'first' FROM flat WHERE step < 2"""),
    "alarms_with_weather": (alarms_with_weather, with_views(f"""
        SELECT a.id, w.line_no, w.join_city, strftime(a.start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts,
               round(hour_temp, 6) + 0.0 AS hour_temp, hour_visibility
        FROM (SELECT * FROM keyed_weather QUALIFY row_number() OVER (
                PARTITION BY join_city, day_key, hour_key ORDER BY line_no, hour_temp NULLS FIRST, hour_visibility NULLS FIRST) = 1) w
        JOIN keyed_alarms a ON {_KEY_MATCH}""", "keyed_alarms", "keyed_weather")),
    "counts_by_temperature": (lambda v: ops.counts_by_temperature(*keyed(v)), with_views(f"""
        SELECT round_even(hour_temp, 0) + 0.0 AS temp_rounded, count(*) AS alarms
        FROM keyed_weather w JOIN keyed_alarms a ON {_KEY_MATCH} GROUP BY 1""", "keyed_alarms", "keyed_weather")),
    "box_by_state": (lambda v: round_columns(ops.visibility_boxes(*keyed(v)), "q1", "median", "q3"), with_views(
        _BOX, "keyed_alarms", "keyed_weather", extra={"samples": _SAMPLES})),
    "union_labeled": (union_labeled, with_views(
        "SELECT state, x AS hour_visibility, count(*) AS n FROM samples GROUP BY 1, 2",
        "keyed_alarms", "keyed_weather", extra={"samples": _SAMPLES})),
    "alarm_start_flag": (alarm_start_flag, with_views("""
        SELECT join_city, strftime(day_key, '%Y-%m-%d') AS day_date, hour_key AS hour, is_alarm, count(*) AS n
        FROM flagged GROUP BY 1, 2, 3, 4""", "keyed_alarms", "keyed_weather", extra={"flagged": _FLAGGED})),
    "correlation_matrix": (correlation_matrix, with_views(
        " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS corr FROM flagged"
                           for a in CORRELATED for b in CORRELATED),
        "keyed_alarms", "keyed_weather", extra={"flagged": _FLAGGED})),
    "forecast_file_quality": (lambda v: int_flags(forecast_file_quality(v), "incomplete", "valid"), with_views(
        _VERDICT, "forecast_hours", extra={"q": FILE_QUALITY})),
    "forecast_day_quality": (lambda v: int_flags(forecast_quality(v), "incomplete", "valid"), with_views(
        _VERDICT, "weather", extra={"q": DAY_QUALITY})),
    "forecast_quality_summary": (lambda v: quality.forecast_quality_summary(forecast_file_quality(v)), with_views(
        "SELECT count(*) FILTER (hours = 24 AND nulls = 0 AND out_of_range = 0) AS valid_files, count(*) AS files FROM q",
        "forecast_hours", extra={"q": FILE_QUALITY})),
    "nest_weather_days": (nest_weather_days, with_views("""
        SELECT x.city, x.date, x.day_tempmax, latitude, x.n_hours, min(hour_datetime) FILTER (hour_datetime <> '') AS first_hour,
               max(hour_datetime) FILTER (hour_datetime <> '') AS last_hour
        FROM x JOIN r USING (city, date) GROUP BY 1, 2, 3, 4, 5""", "weather_text", extra={"r": _ROWS, "x": _DAY_ROWS})),
    "weather_day_issues": (weather_day_issues, with_views(_ISSUE_ROWS, "weather_text", extra=ISSUE_VIEWS)),
    "global_issues": (lambda v: quality.global_issues(weather_day_issues(v)).select("severity", "city", "category", "message", "file"), with_views(
        "SELECT severity, city, category, message, file FROM (" + _ISSUE_ROWS + ") ORDER BY severity, city",
        "weather_text", extra=ISSUE_VIEWS)),
    "issue_total": (lambda v: jobs.weather_issue_counts(v.weather_text).agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("total")), with_views(
        "SELECT count(*) AS total FROM issues", "weather_text", extra=ISSUE_VIEWS)),
    "sorted_issues": (lambda v: quality.sorted_issues(weather_day_issues(v)).select("city", "severity", "category", "message"), with_views(
        "SELECT city, 'ERROR' AS severity, category, message FROM issues ORDER BY 1, 2", "weather_text", extra=ISSUE_VIEWS)),
    "city_coverage": (city_coverage, with_views(
        "SELECT *, round(days * 100.0 / expected, 6) AS coverage FROM c",
        "weather_text", extra={"r": _ROWS, "x": _DAY_ROWS, "c": _COVERAGE})),
    "city_quality_status": (city_quality_status, with_views("""
        SELECT c.city, c.days, coalesce(n, 0) AS issues, coalesce(n, 0) AS errors, CAST(n IS NULL AS INT) AS clean
        FROM c LEFT JOIN (SELECT city, count(*) AS n FROM issues GROUP BY 1) i USING (city)""",
        "weather_text", extra={**ISSUE_VIEWS, "c": _COVERAGE})),
    "weather_range_filter": (
        lambda v: round_columns(ops.weather_range_filter(v.weather, READINGS).select("line_no", "region_id", *READINGS.values()),
                                *READINGS.values()),
        with_views("SELECT line_no, region_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in READINGS.values())
                   + f" FROM weather WHERE {_RANGE_OK}", "weather")),
    "weather_range_flag": (
        lambda v: int_flags(ops.weather_range_filter(v.weather, READINGS, mode="flag"), "in_range").groupBy("region_id", "in_range")
        .agg(F.count(F.lit(1)).alias("n")),
        with_views(f"SELECT region_id, CAST({_RANGE_OK} AS INT) AS in_range, count(*) AS n FROM weather GROUP BY 1, 2", "weather")),
    "region_weather_now": (
        lambda v: round_columns(
            ops.region_weather_now(v.weather, ["hour_ts", "line_no"], NOW_FIELDS).withColumn("hour_ts", stamp("hour_ts")),
            *[c for c in NOW_FIELDS if c != "hour_conditions"]),
        with_views("SELECT region_id, strftime(w.hour_ts, '%Y-%m-%d %H:%M:%S') AS hour_ts, w.line_no, "
                   + ", ".join(f"round(w.{c}, 6) + 0.0 AS {c}" for c in NOW_FIELDS if c != "hour_conditions")
                   + ", w.hour_conditions FROM (SELECT region_id, max(struct_pack(hour_ts := hour_ts, line_no := line_no, "
                   + ", ".join(f"{c} := {c}" for c in NOW_FIELDS) + ")) AS w FROM weather GROUP BY 1)", "weather")),
}
