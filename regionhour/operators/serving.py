"""Serving tables: current status, base-rate forecasts, timelines, daily statistics.

Only the shape of these tables is given by the source material. How the numbers
are computed is our definition and stated with each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.constants import HORIZONS, SHAPE_REGIONS
from regionhour.functions.numeric import prob_to_level
from regionhour.functions.text import hhmm


def crosswalk(spark: SparkSession, pairs: dict[str, str] = SHAPE_REGIONS) -> DataFrame:
    """Literal table of names and ids: map shapes, or weather regions and their locations."""
    return spark.createDataFrame(list(pairs.items()), "name string, region string")


def region_crosswalk(names: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Conformed id of each name; an unknown name passes through. ``xwalk`` is a fixed literal table."""
    return names.join(F.broadcast(xwalk), "name", "left").withColumn("region", F.coalesce("region", "name"))


def active_at(alarms: DataFrame, at: str) -> DataFrame:
    moment = F.lit(at).cast("timestamp")
    return alarms.where((F.col("start") <= moment) & (moment < F.col("end")))


def first_alert_per_region(alerts: DataFrame, snapshot: str) -> DataFrame:
    """First alert in array order of each region and snapshot; alerts without a region are left out.

    ``alerts`` is one row per array element with its position ``pos``.
    """
    named = alerts.where(F.coalesce("location_oblast", F.lit("")) != "")
    first = F.min(F.struct("pos", "alert_type", "started_at")).alias("a")
    return named.groupBy(snapshot, "location_oblast").agg(first).select(
        snapshot, "location_oblast",
        F.coalesce("a.alert_type", F.lit("unknown")).alias("type"), hhmm(F.col("a.started_at")).alias("since"),
    )


def active_count(first_alerts: DataFrame, snapshot: str) -> DataFrame:
    return first_alerts.groupBy(snapshot).agg(F.count(F.lit(1)).alias("active_count"))


def overlay_region_status(regions: DataFrame, alarms: DataFrame) -> DataFrame:
    """Every region with its alarm; inactive and safe when it has none."""
    return regions.join(alarms, "region_id", "left").withColumns({
        "active": F.coalesce("active", F.lit(False)),
        "threat_level": F.coalesce("threat_level", F.lit("safe")),
    })


def base_rate_forecast(labels: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Share of past hours, by region and hour of day, that an alarm followed within 1, 3, 6, 12 hours.

    Pass labels of the training period only (a grid that ends at the cutoff);
    hours too close to the cutoff have null labels and do not count.
    """
    return labels.groupBy("region_id", F.hour("hour_ts").alias("hour")).agg(
        *[F.avg(f"alarm_next_{h}h").alias(f"probability_{h}h") for h in horizons]
    )


def prediction(forecast: DataFrame, mix: DataFrame, regions: DataFrame, at: str) -> DataFrame:
    """Forecast rows of the hour of day of ``at`` with name, level and type shares as a map."""
    hour = F.hour(F.lit(at).cast("timestamp"))
    shares = mix.groupBy("region_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("alert_type", "share")))).alias("threat_types")
    )
    return (
        forecast.where(F.col("hour") == hour).drop("hour")
        .join(shares, "region_id", "left").join(regions, "region_id")
        .withColumn("threat_level", prob_to_level(F.col("probability_1h")))
        .withColumn("updated_at", F.lit(at))
    )


def current_alarms(alarms: DataFrame, regions: DataFrame, forecast: DataFrame, at: str, name: str = "center_city_en") -> DataFrame:
    """Every region at a moment: active or not, type and start of its earliest active alarm, level.

    The level is the band of the forecast for the next hour at that hour of day.
    """
    earliest = F.min(F.struct("start", "id", "alert_type")).alias("a")
    active = active_at(alarms, at).groupBy("region_id").agg(earliest).select(
        "region_id", F.lit(True).alias("active"), F.col("a.alert_type").alias("type"), F.col("a.start").alias("since")
    )
    level = forecast.where(F.col("hour") == F.hour(F.lit(at).cast("timestamp"))).select(
        "region_id", prob_to_level(F.col("probability_1h")).alias("threat_level")
    )
    status = regions.select("region_id", F.col(name).alias("name")).join(level, "region_id", "left")
    return overlay_region_status(status.join(active, "region_id", "left"), regions.select("region_id"))


def threat_mix(alarms: DataFrame, cutoff: str) -> DataFrame:
    """Share of each alert type per region before the cutoff; shares are taken from counts."""
    counts = (
        alarms.where((F.col("start") < F.lit(cutoff).cast("timestamp")) & F.col("alert_type").isNotNull())
        .groupBy("region_id", "alert_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("region_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "region_id").select("region_id", "alert_type", (F.col("n") / F.col("total")).alias("share"))


def timeline(forecast: DataFrame, mix: DataFrame, types: list[str]) -> DataFrame:
    """Twelve two-hour slots per region: probability of the next hour, split by type."""
    shares = mix.groupBy("region_id").agg(
        *[F.coalesce(F.max(F.when(F.col("alert_type") == t, F.col("share"))), F.lit(0.0)).alias(f"_{t}") for t in types]
    )
    slots = forecast.where(F.col("hour") % 2 == 0)
    p = F.col("probability_1h")
    return slots.join(shares, "region_id", "left").select(
        "region_id",
        F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("hour"),
        p.alias("probability"),
        *[(p * F.coalesce(f"_{t}", F.lit(0.0))).alias(t) for t in types],
    )


def alarms_today_stats(
    alarms: DataFrame, regions: DataFrame, forecast: DataFrame, at: str, name: str = "center_city_en"
) -> DataFrame:
    """One row for the day of ``at``; the alarms are read once.

    Average level is ten times the mean forecast for the next hour, the most
    threatened region has the highest one, and hours are clipped to the day.
    """
    moment = F.lit(at).cast("timestamp")
    day = F.date_trunc("day", moment)
    next_day = day + F.make_dt_interval(F.lit(1))
    start, end = F.col("start"), F.col("end")
    overlap = F.unix_micros(F.least("end", next_day)) - F.unix_micros(F.greatest("start", day))
    # Per region first, so that the regions active at the moment are counted without a distinct.
    per_region = alarms.where((start < next_day) & ((end > day) | (start >= day))).groupBy("region_id").agg(
        F.max((start <= moment) & (moment < end) & F.col("region_id").isNotNull()).alias("active"),
        F.sum(F.when((end > start) & (end > day), overlap).otherwise(0)).alias("micros"),
        F.count_if(start >= day).alias("started"),
    )
    facts = per_region.agg(F.struct(
        F.count_if("active").alias("active"), F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"),
        F.coalesce(F.sum("started"), F.lit(0)).alias("started"),
    ).alias("facts")).scalar()

    now = forecast.where(F.col("hour") == F.hour(moment))
    levels = regions.join(now, "region_id", "left").withColumn("_p", F.coalesce("probability_1h", F.lit(0.0)))
    worst = F.min_by(name, F.struct(-F.col("_p"), F.col(name)))
    return levels.agg(
        F.count(F.lit(1)).alias("total_regions"),
        (F.avg("_p") * 10).alias("avg_threat_level"),
        worst.alias("most_threatened_region"),
    ).select(
        facts["active"].alias("active_alarms_count"), "total_regions", "avg_threat_level", "most_threatened_region",
        facts["started"].alias("total_alarms_today"), (facts["micros"] / F.lit(3_600_000_000.0)).alias("total_duration_today_hours"),
    )
