"""Alarm intervals: joins to regions, counts, distributions, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regionhour.constants import (
    ALARM_UPPER_BOUND,
    EXPECTED_REGIONS,
    FIRST_DAY,
    KNOWN_DATES,
    MAX_ALARM_HOURS,
    SUSPECT_WORDS,
    WEEKDAY_NAMES,
)
from regionhour.functions.calendar import weekday, year_month
from regionhour.functions.numeric import duration_minutes
from regionhour.operators.profile import box_summary
from regionhour.operators.running import exact_quantiles, one_row, value_bin, value_counts, with_facts


def with_region(alarms: DataFrame, regions: DataFrame) -> DataFrame:
    """Left join on ``region_id``. Spark broadcasts the dimension when its measured size allows."""
    return alarms.join(regions, "region_id", "left")


def with_duration(alarms: DataFrame) -> DataFrame:
    minutes = duration_minutes(F.col("start"), F.col("end"))
    return alarms.withColumn("duration_minutes", minutes).withColumn("valid", F.col("duration_minutes") > 0)


def valid_durations(alarms: DataFrame) -> DataFrame:
    return with_duration(alarms).where("valid")


def count_rows(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("alarms"))


def counts_by_region(alarms: DataFrame, name: str = "center_city_ua") -> DataFrame:
    return count_rows(alarms.where(F.col(name).isNotNull()), name)


def counts_by_hour(alarms: DataFrame) -> DataFrame:
    return count_rows(alarms.where(F.col("start").isNotNull()), F.hour("start").alias("hour"))


def counts_by_weekday(alarms: DataFrame, names: list[str] = WEEKDAY_NAMES) -> DataFrame:
    labels = F.array(*map(F.lit, names))
    counted = count_rows(alarms.where(F.col("start").isNotNull()), weekday(F.col("start")).alias("day_of_week"))
    return counted.withColumn("day_name", F.element_at(labels, F.col("day_of_week") + 1))


def counts_by_month(alarms: DataFrame) -> DataFrame:
    return count_rows(alarms.where(F.col("start").isNotNull()), year_month(F.col("start")).alias("year_month"))


def counts_by_day(alarms: DataFrame) -> DataFrame:
    """Days without an alarm are absent."""
    return count_rows(alarms.where(F.col("start").isNotNull()), F.to_date("start").alias("date_only"))


def monthly_trend(monthly: DataFrame, months: int = 3) -> DataFrame:
    """Mean of the last ``months`` present months, null until there are that many.

    The window runs over months already counted: one row per calendar month.
    """
    recent = Window.orderBy("year_month").rowsBetween(1 - months, 0)
    full = F.count(F.lit(1)).over(recent) == months
    return monthly.withColumn("rolling_mean", F.when(full, F.avg("alarms").over(recent)))


def daily_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(F.avg("alarms").alias("mean_per_day"), F.max("alarms").alias("max_per_day"))


def region_hour_crosstab(alarms: DataFrame, name: str = "center_city_ua") -> DataFrame:
    """Region by hour of day, absent pairs 0."""
    return (
        alarms.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(*[F.count_if(F.hour("start") == h).alias(f"h{h:02d}") for h in range(24)])
    )


def calendar_matrix(daily: DataFrame, year: int) -> DataFrame:
    """Month by day of month of one year; days without alarms stay null."""
    in_year = daily.where(F.year("date_only") == year)
    return in_year.groupBy(F.month("date_only").alias("month")).agg(*[
        F.sum(F.when(F.dayofmonth("date_only") == d, F.col("alarms"))).alias(f"d{d:02d}") for d in range(1, 32)
    ])


def daily_histogram(daily: DataFrame, bins: int = 50) -> DataFrame:
    """Equal bins over the range of daily counts; the last one is closed."""
    bounds = daily.agg(
        F.min("alarms").cast("double").alias("low"), F.max("alarms").cast("double").alias("high")
    )
    row = one_row(bounds)
    low, high = row["low"], row["high"]
    placed = daily.select(value_bin(F.col("alarms"), low, high, bins).alias("bin"))
    step = (high - low) / bins
    return (
        placed.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("days"))
        .select("bin", (low + F.col("bin") * step).alias("bin_start"), (low + (F.col("bin") + 1) * step).alias("bin_end"), "days")
    )


def daily_kde(daily: DataFrame, points: int = 200) -> DataFrame:
    """Gaussian kernel density of daily counts on an even grid, Scott bandwidth.

    Each distinct count is spread over the fixed grid and summed per grid point
    before the shuffle, so no pair of days is ever formed.
    """
    counts = daily.groupBy("alarms").agg(F.count(F.lit(1)).alias("days"))
    facts = daily.agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp("alarms") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("width"),
        F.min("alarms").alias("low"),
        F.max("alarms").alias("high"),
    )
    row = one_row(facts)
    n, width, low, high = (row[c] for c in ("n", "width", "low", "high"))
    spread = counts.select(
        "alarms", "days", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    ).withColumn("x", low + F.col("point") * (high - low) / F.lit(float(points - 1)))
    kernel = F.exp(-F.pow((F.col("x") - F.col("alarms")) / width, F.lit(2.0)) / 2)
    scale = n * width * F.sqrt(F.lit(2.0) * F.pi())
    return spread.groupBy("point", "x").agg((F.sum(F.col("days") * kernel) / F.max(scale)).alias("density"))


def duration_box(alarms: DataFrame) -> DataFrame:
    """Quartiles, whiskers and outliers of positive durations."""
    return box_summary(value_counts(valid_durations(alarms), [], "duration_minutes"), [], "duration_minutes")


def duration_summary(alarms: DataFrame) -> DataFrame:
    """Median minutes and longest hours of positive durations."""
    counts = value_counts(valid_durations(alarms), [], "duration_minutes")
    longest = counts.agg((F.max("duration_minutes") / 60).alias("max_hours"))
    return with_facts(exact_quantiles(counts, [], "duration_minutes", {"median_minutes": 0.5}), longest, [])


def top_regions(counts: DataFrame, name: str = "center_city_ua", k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("alarms"), name).limit(k)


def top_bottom_regions(counts: DataFrame, name: str = "center_city_ua", k: int = 5) -> DataFrame:
    top = counts.orderBy(F.desc("alarms"), name).limit(k).withColumn("side", F.lit("top"))
    bottom = counts.orderBy("alarms", F.desc(name)).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def top_days(daily: DataFrame, k: int = 10) -> DataFrame:
    return daily.orderBy(F.desc("alarms"), "date_only").limit(k)


def known_events_check(daily: DataFrame, dates: list[str] = KNOWN_DATES) -> DataFrame:
    """Count of each known date, 0 when absent; the dates filter the alarms before they are counted."""
    wanted = [F.lit(d).cast("date") for d in dates]
    named = daily.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("date_only"))
    return (
        named.join(daily.where(F.col("date_only").isin(wanted)), "date_only", "left")
        .select("date_only", F.coalesce("alarms", F.lit(0)).alias("alarms"))
        .withColumn("zero", F.col("alarms") == 0)
    )


def date_bound_anomalies(alarms: DataFrame, low: str = FIRST_DAY, high: str = ALARM_UPPER_BOUND) -> DataFrame:
    return alarms.agg(
        F.count_if(F.col("start") < F.lit(low).cast("timestamp")).alias("too_early"),
        F.count_if(F.col("start") > F.lit(high).cast("timestamp")).alias("too_late"),
    )


def distinct_years(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.year(ts).alias("year")).distinct()


def region_consistency(alarms: DataFrame, regions: DataFrame, name: str = "center_city_en") -> DataFrame:
    """Region ids whose name in the alarms differs from the dimension, with the number of alarms."""
    seen = count_rows(alarms, "region_id", "region_city")
    differs = ~F.col("region_city").eqNullSafe(F.col(name))
    return seen.join(regions, "region_id", "left").where(differs).select("region_id", "region_city", name, "alarms")


def region_count_check(regions: DataFrame, expected: int = EXPECTED_REGIONS) -> DataFrame:
    return regions.agg(F.count(F.lit(1)).alias("regions")).withColumn("as_expected", F.col("regions") == expected)


def text_anomalies(df: DataFrame, words: list[str] = SUSPECT_WORDS) -> DataFrame:
    """Distinct text values that contain a suspect word, with column and word."""
    columns = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.col("value")), w))
    return (
        df.select(values.alias("cell")).select("cell.*")
        .where(F.col("value").isNotNull())
        .select("column", "value", F.explode(hits).alias("word"))
        .distinct()
    )


def impossible_intervals(alarms: DataFrame, max_hours: int = MAX_ALARM_HOURS) -> DataFrame:
    seconds = duration_minutes(F.col("start"), F.col("end")) * 60
    return alarms.agg(
        F.count_if(F.col("end") < F.col("start")).alias("end_before_start"),
        F.count_if(seconds < 0).alias("negative_duration"),
        F.count_if(seconds == 0).alias("zero_duration"),
        F.count_if(seconds > max_hours * 3600).alias("too_long"),
    )
