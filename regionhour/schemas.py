"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from regionhour.constants import DAILY_FIELDS, FORECAST_FIELDS, HOURLY_FIELDS


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


ALARMS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("region_id", T.IntegerType()),
    T.StructField("region_city", T.StringType()),
    T.StructField("all_region", T.IntegerType()),
    T.StructField("start", T.TimestampType()),
    T.StructField("end", T.TimestampType()),
])

REGIONS = T.StructType([
    T.StructField("region_id", T.IntegerType()),
    T.StructField("center_city_ua", T.StringType()),
    T.StructField("center_city_en", T.StringType()),
])

WEATHER_CSV = T.StructType(
    _strings(["city_address", "city_latitude", "city_longitude"] + HOURLY_FIELDS + DAILY_FIELDS)
)

WEATHER_DAY = T.StructType([
    T.StructField("daily", T.StructType(_strings(DAILY_FIELDS + ["city", "latitude", "longitude"]))),
    T.StructField("hours", T.ArrayType(T.StructType(_strings(HOURLY_FIELDS)))),
])

FORECAST_HOUR = T.StructType([
    T.StructField(name, T.StringType() if name in ("datetime", "conditions") else T.DoubleType())
    for name in FORECAST_FIELDS
])

FORECAST = T.StructType([
    T.StructField("region", T.StringType()),
    T.StructField("request_timestamp", T.StringType()),
    T.StructField("forecast", T.ArrayType(FORECAST_HOUR)),
])

FORECAST_API = T.StructType([
    T.StructField("days", T.ArrayType(T.StructType([T.StructField("hours", T.ArrayType(FORECAST_HOUR))]))),
])

REPORT = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("char_count", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

SOURCE_ENTRY = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("http_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("error_detail", T.StringType()),
])

REPORT_SOURCES = T.StructType([
    T.StructField("report_date", T.StringType()),
    T.StructField("html_file", T.StringType()),
    T.StructField("sources_count", T.IntegerType()),
    T.StructField("resolved_count", T.IntegerType()),
    T.StructField("dead_count", T.IntegerType()),
    T.StructField("blocked_count", T.IntegerType()),
    T.StructField("non_html_count", T.IntegerType()),
    T.StructField("sources", T.ArrayType(SOURCE_ENTRY)),
])

ALERT = T.StructType([
    T.StructField("location_oblast", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("started_at", T.StringType()),
])

ALERT_SNAPSHOT = T.StructType([T.StructField("alerts", T.ArrayType(ALERT))])
