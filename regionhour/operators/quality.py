"""Quality of forecast documents and historical weather days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.constants import (
    DAILY_FIELDS,
    DAY_TOLERANCE,
    EXPECTED_HOURS,
    HOURLY_FIELDS,
    LATITUDE,
    LONGITUDE,
    RANGES,
    REQUIRED_HOURLY,
)
from regionhour.functions.numeric import between_inclusive, safe_double

DAY_KEY = ["city", "date"]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def forecast_hours(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hour; a document without hours keeps one row with ``present`` false."""
    return forecasts.select(*keys, F.explode_outer("forecast").alias("h")).select(
        *keys, F.col("h").isNotNull().alias("present"), *[F.col("h")[f].alias(f) for f in RANGES]
    )


def forecast_file_quality(hours: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Hours, nulls and out-of-range values per document; a null is not out of range."""
    present = F.col("present")
    nulls = _sum([F.col(f).isNull().cast("int") for f in ranges])
    outside = _sum([F.coalesce(~between_inclusive(F.col(f), b), F.lit(False)).cast("int") for f, b in ranges.items()])
    counted = hours.groupBy(*keys).agg(
        F.count_if(present).alias("hours"),
        F.coalesce(F.sum(F.when(present, nulls)), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(present, outside)), F.lit(0)).alias("out_of_range"),
    )
    return _with_verdict(counted)


def forecast_document_quality(
    forecasts: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]] = RANGES
) -> DataFrame:
    """The same counts from documents; ``keys`` name one document.

    Hours leave their array inside generated code and are added up before the shuffle, which moves
    one row per document. Counting inside the array would run every rule interpreted, at a third of the speed.
    """
    return forecast_file_quality(forecast_hours(forecasts, keys), keys, ranges)


def _with_verdict(counted: DataFrame) -> DataFrame:
    return counted.withColumn("incomplete", F.col("hours") != EXPECTED_HOURS).withColumn(
        "valid", ~F.col("incomplete") & (F.col("nulls") == 0) & (F.col("out_of_range") == 0)
    )


def forecast_quality_summary(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count_if("valid").alias("valid_files"), F.count(F.lit(1)).alias("files"))


def weather_rows(weather: DataFrame) -> DataFrame:
    """Wide rows that have a city and a date, with the city taken from the address."""
    city = F.trim(F.substring_index("city_address", ",", 1))
    return weather.withColumn("city", city).withColumn("date", F.col("day_datetime")).where(
        (F.coalesce("city", F.lit("")) != "") & (F.coalesce("date", F.lit("")) != "")
    )


def weather_day_table(rows: DataFrame) -> DataFrame:
    """One row per city and date: daily fields of its first line, and the number of hours with a time."""
    daily = [c for c in DAILY_FIELDS if c in rows.columns]
    first = F.min(F.struct("line_no", *daily, "city_latitude", "city_longitude")).alias("first")
    timed = F.coalesce("hour_datetime", F.lit("")) != ""
    return rows.groupBy(*DAY_KEY).agg(first, F.count_if(timed).alias("n_hours")).select(
        *DAY_KEY,
        *[F.col("first")[c].alias(c) for c in daily],
        F.col("first.city_latitude").alias("latitude"),
        F.col("first.city_longitude").alias("longitude"),
        "n_hours",
    )


def weather_hour_rows(rows: DataFrame) -> DataFrame:
    """Hours with a time, in long form."""
    hourly = [c for c in HOURLY_FIELDS if c in rows.columns]
    return rows.where(F.coalesce("hour_datetime", F.lit("")) != "").select(*DAY_KEY, "line_no", *hourly)


def nest_weather_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """One document per city and date, hours sorted by time.

    ``weather_hour_rows`` is the long form (city, date, line_no, hour fields), which has no
    size limit; a document holds the hours of one day.
    """
    daily = [c for c in DAILY_FIELDS if c in rows.columns]
    hours = weather_hour_rows(rows)
    hourly = [c for c in HOURLY_FIELDS if c in rows.columns]
    sort_first = ["hour_datetime", "line_no", *[c for c in hourly if c != "hour_datetime"]]
    gathered = hours.groupBy(*DAY_KEY).agg(
        F.array_sort(F.collect_list(F.struct(*sort_first))).alias("hours")
    )
    document = F.struct(*daily, "city", "latitude", "longitude").alias("daily")
    return days.select(*DAY_KEY, document).join(gathered, DAY_KEY, "left").select(
        *DAY_KEY, "daily",
        F.transform(
            F.coalesce("hours", F.array().cast(gathered.schema["hours"].dataType)),
            lambda h: F.struct(*[h[c].alias(c) for c in hourly]),
        ).alias("hours"),
    )


def split_day_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(days, hours) of nested documents keyed by city, date and file; hours carry the day bounds."""
    days = documents.select(
        *DAY_KEY, "file", *[F.col(f"daily.{c}") for c in (*DAILY_FIELDS, "latitude", "longitude")],
        F.greatest(F.coalesce(F.size("hours"), F.lit(0)), F.lit(0)).alias("n_hours"),
    )
    bounds = ["daily.day_tempmax", "daily.day_tempmin"]
    hours = documents.select(*DAY_KEY, "file", *bounds, F.explode("hours").alias("h")).select(
        *DAY_KEY, "file", "day_tempmax", "day_tempmin", "h.*"
    )
    return days, hours


# Condition, category and message of one check; a null condition is no issue.
Rule = tuple[Column, str, Column]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _explode_issues(df: DataFrame, rules: list[Rule]) -> DataFrame:
    issues = [F.when(condition, F.struct(F.lit("ERROR").alias("severity"), F.lit(category).alias("category"), message.alias("message")))
              for condition, category, message in rules]
    return (
        df.select(*DAY_KEY, "file", F.explode(F.array(*issues)).alias("issue"))
        .where(F.col("issue").isNotNull())
        .select(*DAY_KEY, "file", "issue.*")
    )


def _count_issues(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``city, issues`` straight from the conditions: no message is built and no row is made for an issue."""
    met = _sum([F.coalesce(condition, F.lit(False)).cast("long") for condition, _, _ in rules])
    return df.groupBy("city").agg(F.sum(met).alias("issues"))


def _day_rules(strict: bool) -> list[Rule]:
    rules = [(F.col("n_hours") != EXPECTED_HOURS, "CHRONOLOGY", _text(f"Expected {EXPECTED_HOURS}h, found ", F.col("n_hours"), "h"))]
    for name, column, bounds in (("Lat", "latitude", LATITUDE), ("Lon", "longitude", LONGITUDE)):
        c = safe_double(F.col(column))
        tested = c.isNotNull() if strict else c.isNotNull() & (c != 0)
        rules.append((tested & ~between_inclusive(c, bounds), "GEOGRAPHY", _text(f"{name} ", c, " outside Ukraine")))
    return rules


def _numbers(hours: DataFrame, *columns: str) -> DataFrame:
    return hours.select(*columns, *[safe_double(F.col(c)).alias(c) for c in ("day_tempmax", "day_tempmin", *REQUIRED_HOURLY)])


def _hour_rules() -> list[Rule]:
    """Rules over ``_numbers``, with the clock in ``hour_datetime``."""
    temp, top, bottom = F.col("hour_temp"), F.col("day_tempmax"), F.col("day_tempmin")
    clock = F.coalesce("hour_datetime", F.lit("None"))
    rules = [
        (~F.isnan(temp) & ~F.isnan(top) & (temp > top + DAY_TOLERANCE), "CONSISTENCY", _text("Hour ", clock, ": ", temp, " > Day Max ", top)),
        (~F.isnan(temp) & ~F.isnan(bottom) & (temp < bottom - DAY_TOLERANCE), "CONSISTENCY", _text("Hour ", clock, ": ", temp, " < Day Min ", bottom)),
    ]
    for name in REQUIRED_HOURLY:
        bounds = RANGES[name.removeprefix("hour_")]
        value = F.col(name)
        rules.append((value.isNull(), "NULL", F.lit(f"Empty {name}")))
        rules.append((value.isNotNull() & ~between_inclusive(value, bounds), "RANGE", _text(f"{name}=", value, f" out of {bounds[0]}..{bounds[1]}")))
    return rules


def day_level_issues(days: DataFrame, strict: bool = False) -> DataFrame:
    """Wrong number of hours and coordinates outside the area.

    A coordinate of exactly 0 passes unless ``strict``.
    """
    return _explode_issues(days, _day_rules(strict))


def hour_level_issues(hours: DataFrame) -> DataFrame:
    """Hours beyond the day's extremes, and missing or impossible required values; one pass over the hours."""
    return _explode_issues(_numbers(hours, *DAY_KEY, "file", "hour_datetime"), _hour_rules())


def weather_day_issues(days: DataFrame, hours: DataFrame, strict: bool = False) -> DataFrame:
    return day_level_issues(days, strict).unionByName(hour_level_issues(hours))


def _with_bounds(rows: DataFrame, days: DataFrame) -> DataFrame:
    return weather_hour_rows(rows).join(days.select(*DAY_KEY, "day_tempmax", "day_tempmin"), DAY_KEY)


def csv_day_issues(rows: DataFrame, days: DataFrame, strict: bool = False) -> DataFrame:
    """Issues straight from wide rows; hours meet their day through an equi-join, nothing is nested.

    ``days`` is the table of ``weather_day_table``. It is read more than once, so
    long runs hand in a stored one.
    """
    file = F.concat("date", F.lit(".json")).alias("file")
    return weather_day_issues(days.select("*", file), _with_bounds(rows, days).select("*", file), strict)


def csv_issue_counts(rows: DataFrame, days: DataFrame, strict: bool = False) -> DataFrame:
    """``city, issues``: how many rows ``csv_day_issues`` has per city, for every city that has a day."""
    of_hours = _count_issues(_numbers(_with_bounds(rows, days), "city", "hour_datetime"), _hour_rules())
    return _count_issues(days, _day_rules(strict)).unionByName(of_hours).groupBy("city").agg(F.sum("issues").alias("issues"))


def city_coverage(days: DataFrame, date: Column) -> DataFrame:
    """Days present against days between the first and the last."""
    return (
        days.where(date.isNotNull())
        .groupBy("city")
        .agg(F.count(F.lit(1)).alias("days"), F.min(date).alias("first_day"), F.max(date).alias("last_day"))
        .withColumn("expected", (F.date_diff("last_day", "first_day") + 1).cast("long"))
        .withColumn("coverage", F.col("days") / F.col("expected") * 100)
    )


def city_quality_status(coverage: DataFrame, issues: DataFrame) -> DataFrame:
    """Coverage with the number of issues and errors; ``clean`` when there are none."""
    counted = issues.groupBy("city").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "ERROR").alias("errors")
    )
    return _with_counts(coverage, counted)


def city_status_of_counts(coverage: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from ``csv_issue_counts``; all of its issues are errors."""
    return _with_counts(coverage, counts.withColumn("errors", F.col("issues")))


def _with_counts(coverage: DataFrame, counted: DataFrame) -> DataFrame:
    return (
        coverage.join(counted, "city", "left")
        .fillna(0, ["issues", "errors"])
        .withColumn("clean", F.col("issues") == 0)
    )


def global_issues(issues: DataFrame) -> DataFrame:
    """All issues by severity, then city.

    The sort is a range-partitioned one; the columns behind let a city with very
    many issues spread over several ranges.
    """
    return issues.orderBy("severity", "city", "date", "category", "message")


def issue_total(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count(F.lit(1)).alias("total"))


def sorted_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("city", "severity", "date", "category", "message")
