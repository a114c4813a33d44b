"""Calendar parts and time keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.constants import FIRST_DAY


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add hour, day_of_week, month, year, day, date_only and year_month of ``ts``."""
    c = F.col(ts)
    return df.withColumns({
        "hour": F.hour(c),
        "day_of_week": weekday(c),
        "month": F.month(c),
        "year": F.year(c),
        "day": F.dayofmonth(c),
        "date_only": F.to_date(c),
        "year_month": year_month(c),
    })


def text_date(c: Column) -> Column:
    """Date of a ``yyyy-MM-dd`` text, with or without a time behind it; null when it is not one."""
    return F.trim(c).try_cast("date")


def text_hour(c: Column) -> Column:
    """Hour of a clock text, with or without a date before it; null when it is not one."""
    text = F.nullif(F.trim(c), F.lit(""))
    dated = F.when(F.contains(text, F.lit("-")), text).otherwise(F.concat(F.lit("1970-01-01 "), text))
    return F.hour(dated.try_cast("timestamp_ntz"))


def weather_timestamp(df: DataFrame) -> DataFrame:
    """Add ``day_date`` (from ``day_datetime``) and ``hour`` (from ``hour_datetime``).

    The hour column carries a time of day only, so its own date is never used.
    """
    return df.withColumns({"day_date": text_date(F.col("day_datetime")), "hour": text_hour(F.col("hour_datetime"))})


def clamp_range(start: Column, end: Column, today: Column, first_day: str = FIRST_DAY) -> dict[str, Column]:
    """Asked bounds moved inside ``first_day .. today``; ``valid`` is false for a range that cannot run."""
    low = F.lit(first_day).cast("date")
    lower = F.greatest(F.coalesce(start, low), low)
    upper = F.least(F.coalesce(end, today), today)
    asked_backwards = F.coalesce(start > end, F.lit(False))
    return {
        "range_start": lower,
        "range_end": upper,
        "valid": ~asked_backwards & (lower <= today) & (lower <= upper),
    }
