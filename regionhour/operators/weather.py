"""Hourly weather: flattening, keys, joins to alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.constants import FORECAST_FIELDS, RANGES, WEATHER_MAIN
from regionhour.functions.calendar import weather_timestamp
from regionhour.functions.numeric import between_inclusive, round_half_even
from regionhour.functions.text import city_key, name_key
from regionhour.operators.profile import box_summary, drop_incomplete_keys

KEY = ["join_city", "day_date", "hour"]


def select_weather_main(weather: DataFrame) -> DataFrame:
    return weather.select(*WEATHER_MAIN)


def flatten_forecast(documents: DataFrame, first_day_only: bool = False) -> DataFrame:
    """One row per hour of ``days[].hours[]`` with the kept fields.

    ``first_day_only`` keeps the first day of each document, which loses hours
    after midnight.
    """
    days = F.slice("days", 1, 1) if first_day_only else F.col("days")
    hours = F.explode(F.flatten(F.transform(days, lambda d: d["hours"])))
    carried = [c for c in documents.columns if c != "days"]
    return documents.select(*carried, hours.alias("h")).select(*carried, *[F.col("h")[f].alias(f) for f in FORECAST_FIELDS])


def forecast_documents(hours: DataFrame) -> DataFrame:
    """Flattened hours back to one document per request and region: ``forecast[]`` in the order of request, then clock.

    Clock times before the request's hour belong to the next day. A request holds the hours of two days.
    """
    start = F.concat(F.substring("request_hour", 12, 2), F.lit(":00:00"))
    entry = F.struct(
        (F.col("datetime") < start).alias("_next_day"), F.col("datetime").alias("_at"), F.struct(*FORECAST_FIELDS).alias("hour")
    )
    return hours.groupBy("region", "request_hour").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        "region", "request_hour", F.col("request_hour").alias("request_timestamp"), F.col("entries.hour").alias("forecast")
    )


def weather_keys(weather: DataFrame) -> DataFrame:
    """Rows with a full (city, date, hour) key; the date comes from the day column."""
    keyed = weather_timestamp(weather).withColumn("join_city", city_key(F.col("city_address")))
    return drop_incomplete_keys(keyed, KEY, ["hour"])


def alarm_keys(alarms: DataFrame, name: str = "center_city_en") -> DataFrame:
    keyed = alarms.withColumns({
        "join_city": name_key(F.col(name)), "day_date": F.to_date("start"), "hour": F.hour("start"),
    })
    return drop_incomplete_keys(keyed, KEY, ["hour"])


def weather_at_alarms(weather: DataFrame, alarms: DataFrame) -> DataFrame:
    """Keyed weather of the hours that have an alarm; all other rows go before anything is grouped."""
    return weather.join(alarms.select(*KEY).distinct(), KEY, "left_semi")


def one_per_hour(weather: DataFrame, *order: str) -> DataFrame:
    """Of several keyed weather rows of one hour the least by ``order``, then by the other columns, nulls first.

    All columns take part, so rows that differ never tie. Partial minima go into the shuffle.
    """
    others = [c for c in weather.columns if c not in (*KEY, *order)]
    first = F.min(F.struct(*order, *others)).alias("w")
    return weather.groupBy(*KEY).agg(first).select(*KEY, "w.*")


def alarms_with_weather(alarms: DataFrame, weather: DataFrame) -> DataFrame:
    """Inner join of keyed alarms and keyed weather. Weather with one row per hour (``one_per_hour``) gives at most one row per alarm."""
    repeated = [c for c in weather.columns if c in alarms.columns and c not in KEY]
    return alarms.join(weather.drop(*repeated), KEY)


def _alarms_per_key(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy(*KEY).agg(F.count(F.lit(1)).alias("alarms"))


def value_hours(alarms: DataFrame, weather: DataFrame, value: Column, name: str) -> DataFrame:
    """Per weather value, the rows of the alarm-weather join (``during``) and all weather rows (``overall``).

    The join itself is not built: both sides shrink to counts per key first, and
    alarms times equal weather rows is the number of joined rows.
    """
    readings = weather.select(*KEY, value.alias(name)).where(F.col(name).isNotNull())
    counted = readings.groupBy(*KEY, name).agg(F.count(F.lit(1)).alias("readings"))
    return (
        counted.join(_alarms_per_key(alarms), KEY, "left")
        .groupBy(name)
        .agg(
            F.sum(F.col("readings") * F.coalesce("alarms", F.lit(0))).alias("during"),
            F.sum("readings").alias("overall"),
        )
    )


def counts_by_temperature(alarms: DataFrame, weather: DataFrame) -> DataFrame:
    """Joined alarms by temperature rounded half to even."""
    rounded = round_half_even(F.col("hour_temp")) + F.lit(0.0)
    hours = value_hours(alarms, weather, rounded, "temp_rounded")
    return hours.where("during > 0").select("temp_rounded", F.col("during").alias("alarms"))


def visibility_boxes(alarms: DataFrame, weather: DataFrame) -> DataFrame:
    """Box of visibility during alarms against all hours, from one pass over the weather."""
    states = F.explode(F.array(
        F.struct(F.lit("during alarms").alias("state"), F.col("during").alias("n")),
        F.struct(F.lit("overall").alias("state"), F.col("overall").alias("n")),
    )).alias("s")
    counts = value_hours(alarms, weather, F.col("hour_visibility"), "hour_visibility")
    both = counts.select("hour_visibility", states).select("hour_visibility", "s.*").where("n > 0")
    return box_summary(both, ["state"], "hour_visibility")


def alarm_start_flag(weather: DataFrame, alarms: DataFrame) -> DataFrame:
    """Weather rows with 1 where an alarm starts in that city and hour, else 0."""
    starts = alarms.select(*KEY).distinct().withColumn("is_alarm", F.lit(1))
    return weather.join(starts, KEY, "left").fillna(0, ["is_alarm"])


def in_range(field: str, column: Column) -> Column:
    """Null counts as in range: a missing value breaks no bound."""
    return F.coalesce(between_inclusive(column, RANGES[field]), F.lit(True))


def weather_range_filter(weather: DataFrame, columns: dict[str, str], mode: str = "drop") -> DataFrame:
    """Drop rows outside the physical ranges, or add ``in_range``; ``columns`` maps field to column."""
    ok = F.lit(True)
    for field, column in columns.items():
        ok = ok & in_range(field, F.col(column))
    return weather.where(ok) if mode == "drop" else weather.withColumn("in_range", ok)


def region_weather_now(weather: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """Latest hour of weather per region; partial maxima go into the shuffle."""
    newest = F.max(F.struct(*order, *fields)).alias("w")
    return weather.groupBy("region_id").agg(newest).select("region_id", *[F.col("w")[c].alias(c) for c in [*order, *fields]])
