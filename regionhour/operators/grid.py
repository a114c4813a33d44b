"""Region by hour integration: flags, labels, lagged features, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regionhour.constants import ALARM_UPPER_BOUND, FIRST_DAY, HORIZONS, MAX_ALARM_HOURS

KEY = ["region_id", "hour_ts"]


def _hours(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0))


def _timestamp(moment: str | Column) -> Column:
    return F.lit(moment).cast("timestamp")


def _hour_number(moment: Column) -> Column:
    """Whole hours since 1970, rounded down."""
    return F.floor(F.unix_seconds(moment) / 3600)


def interval_fault(earliest: str = FIRST_DAY, latest: str = ALARM_UPPER_BOUND, max_hours: int = MAX_ALARM_HOURS) -> Column:
    """Why an alarm's dates are implausible, else null: the same rules as the counts of date bounds and impossible intervals."""
    low, high = _timestamp(earliest), _timestamp(latest)
    start, end = F.col("start"), F.col("end")
    seconds = F.unix_micros(end) - F.unix_micros(start)
    return (
        F.when(start.isNull() | end.isNull(), "no start or end")
        .when(start < low, "too early")
        .when(start > high, "too late")
        .when(end < start, "end before start")
        .when(seconds > F.lit(max_hours).cast("long") * 3_600_000_000, "too long")
    )


def sound_intervals(alarms: DataFrame, **limits) -> DataFrame:
    """Alarms without a fault."""
    return alarms.where(interval_fault(**limits).isNull())


def rejected_intervals(alarms: DataFrame, **limits) -> DataFrame:
    """The other alarms with the ``reason``."""
    return alarms.withColumn("reason", interval_fault(**limits)).where(F.col("reason").isNotNull())


def alarm_range(alarms: DataFrame) -> tuple[Column, Column]:
    """(hour of the first start, hour after the last end), as a scalar subquery over one row; at least one hour.

    Both are null where there are no alarms; the grid is empty then. One bad date stretches it over all years; ``sound_intervals`` leaves such alarms out.
    """
    microsecond = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    first = F.date_trunc("hour", F.min("start"))
    last = F.date_trunc("hour", F.max("end") - microsecond) + _hours(1)
    bounds = alarms.agg(F.struct(first.alias("first"), F.greatest(last, first + _hours(1)).alias("last")).alias("bounds")).scalar()
    return bounds["first"], bounds["last"]


def region_hours(regions: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Every hour of every region, start included, end not."""
    first, last = _timestamp(start), _timestamp(end) - _hours(1)
    # Days first, so that no array holds all hours of a range of many years.
    days = regions.select("region_id", F.explode(F.when(first <= last, F.sequence(first, last, _hours(24)))).alias("_day"))
    day = F.col("_day")
    return days.select("region_id", F.explode(F.sequence(day, F.least(last, day + _hours(23)), _hours(1))).alias("hour_ts"))


def day_sweep(alarms: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """One row per (region, day) in which an alarm begins or ends: ``open`` alarms before the day and after each of its 24 hours, and the ``next_day`` of the region.

    A sweep line: an alarm of positive length adds one at its first hour and takes one off after its last. The sums up to each hour of a day are
    added before the shuffle, so any number of overlapping alarms is one row there; what is open is carried from day to day over
    one row per day. Intervals are clipped to the grid.
    """
    first, stop = _hour_number(_timestamp(start)), _hour_number(_timestamp(end))
    microsecond = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001))
    begun = F.greatest(_hour_number(F.col("start")), first)
    ended = F.least(_hour_number(F.col("end") - microsecond) + 1, stop)
    edges = F.array(F.struct(begun.alias("at"), F.lit(1).alias("step")), F.struct(ended.alias("at"), F.lit(-1).alias("step")))
    edge = alarms.where((F.col("end") > F.col("start")) & (begun < ended)).select("region_id", F.explode(edges).alias("e")).select(
        "region_id", F.floor(F.col("e.at") / 24).alias("day"), F.pmod("e.at", F.lit(24)).alias("slot"), "e.step")
    upto = [F.sum(F.when(F.col("slot") <= k, F.col("step")).otherwise(0)).alias(f"_{k}") for k in range(24)]
    days = edge.groupBy("region_id", "day").agg(*upto)
    by_day = Window.partitionBy("region_id").orderBy("day")
    carried = F.coalesce(F.sum("_23").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    swept = days.select("region_id", "day", F.lead("day").over(by_day).alias("next_day"), carried.alias("before"), *[f"_{k}" for k in range(24)])
    return swept.select("region_id", "day", "next_day", "before", F.array(*[F.col("before") + F.col(f"_{k}") for k in range(24)]).alias("open"))


def active_hours(alarms: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Distinct region-hours touched by an alarm of positive length.

    Each hour leaves the sweep once, however many alarms cover it, which turns the overlap with the grid into an equi-join.
    """
    stop = _hour_number(_timestamp(end))
    day = F.col("day")
    inside = F.filter(F.transform("open", lambda n, k: F.when(n > 0, day * 24 + k)), lambda hour: hour.isNotNull())
    # Days without an edge up to the next one are open throughout or not at all.
    lasting = (F.get("open", F.lit(23)) > 0) & (F.col("next_day") > day + 1)
    days = day_sweep(alarms, start, end).select(
        "region_id", "day", "open", F.explode(F.when(lasting, F.sequence(day, F.col("next_day") - 1)).otherwise(F.array(day))).alias("at"))
    hours = F.when(F.col("at") == day, inside).otherwise(F.sequence(F.col("at") * 24, F.col("at") * 24 + 23))
    return days.select("region_id", F.explode(hours).alias("hour")).where(F.col("hour") < stop).select(
        "region_id", F.timestamp_seconds(F.col("hour") * 3600).alias("hour_ts"))


def region_hour_flags(alarms: DataFrame, regions: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Dense grid with 1 where any part of an alarm falls in the hour, else 0."""
    active = active_hours(alarms, start, end).withColumn("is_alarm", F.lit(1))
    return region_hours(regions, start, end).join(active, KEY, "left").fillna(0, ["is_alarm"])


def horizon_labels(flags: DataFrame, end: str | Column, horizons: list[int] = HORIZONS) -> DataFrame:
    """Per region-hour, 1 when an alarm hour follows within h hours; null when fewer than h hours follow.

    Each alarm hour announces itself to the hours before it and the nearest
    announcement wins. The shuffle is on (region, hour), so a busy region is
    spread over its hours instead of being sorted in one window.
    """
    longest = max(horizons)
    ahead = F.when(F.col("is_alarm") == 1, F.sequence(F.lit(0), F.lit(longest))).otherwise(F.array(F.lit(0)))
    told = flags.select("region_id", "hour_ts", "is_alarm", F.explode(ahead).alias("ahead")).select(
        "region_id", (F.col("hour_ts") - _hours(F.col("ahead"))).alias("hour_ts"), "ahead",
        F.when(F.col("ahead") == 0, F.col("is_alarm")).alias("own"),
    )
    nearest = told.groupBy(*KEY).agg(
        F.max("own").alias("is_alarm"), F.min(F.when(F.col("ahead") > 0, F.col("ahead"))).alias("next_in")
    ).where(F.col("is_alarm").isNotNull())
    following = F.floor((F.unix_seconds(_timestamp(end)) - F.unix_seconds("hour_ts")) / 3600) - 1
    return nearest.select(
        *KEY, "is_alarm",
        *[
            F.when(following >= h, F.coalesce((F.col("next_in") <= h).cast("int"), F.lit(0))).alias(f"alarm_next_{h}h")
            for h in horizons
        ],
    )


def hourly_weather(weather: DataFrame, values: list[str]) -> DataFrame:
    """Mean readings per region-hour; several readings of one hour become one row."""
    return weather.groupBy(*KEY).agg(*[F.avg(v).alias(v) for v in values])


def lagged_features(
    grid: DataFrame, weather: DataFrame, reports: DataFrame, weather_values: list[str], report_values: list[str]
) -> DataFrame:
    """Grid rows with weather of the previous hour and the report of the previous day.

    ``weather`` holds one row per region-hour and ``reports`` one row per day;
    both are moved forward in time before the join, so a row never sees its own
    hour or day.
    """
    earlier_weather = weather.select(
        "region_id", (F.col("hour_ts") + _hours(1)).alias("hour_ts"), *[F.col(v).alias(f"prev_{v}") for v in weather_values]
    )
    earlier_report = reports.select(
        F.date_add("report_date", 1).alias("_day"), *[F.col(v).alias(f"prev_{v}") for v in report_values]
    )
    return (
        grid.join(earlier_weather, KEY, "left")
        .withColumn("_day", F.to_date("hour_ts"))
        .join(earlier_report, "_day", "left")
        .drop("_day")
    )


def chronological_split(df: DataFrame, cutoff: str, ts: str = "hour_ts") -> tuple[DataFrame, DataFrame]:
    """(before the cutoff, from the cutoff on); never a random split."""
    return df.where(F.col(ts) < _timestamp(cutoff)), df.where(F.col(ts) >= _timestamp(cutoff))
