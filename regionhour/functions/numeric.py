"""Number rules: casts, durations, rounding and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionhour.constants import COMPASS, LEVEL_BANDS, LEVEL_DEFAULT


def safe_double(c: Column) -> Column:
    """Blank and unreadable text give null."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def duration_minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0)


def prob_to_level(p: Column) -> Column:
    return reduce(
        lambda rest, band: F.when(p >= band[0], band[1]).otherwise(rest),
        reversed(LEVEL_BANDS),
        F.lit(LEVEL_DEFAULT),
    )


def wind_compass(degrees: Column) -> Column:
    """Nearest of eight directions, halves rounded up."""
    sector = F.pmod(F.floor(degrees / 45 + 0.5), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1)


def percent_rounded(p: Column) -> Column:
    return F.floor(p * 100 + 0.5)


def between_inclusive(c: Column, bounds: tuple[float, float]) -> Column:
    """False for NaN, which no range holds."""
    return ~F.isnan(c) & (c >= bounds[0]) & (c <= bounds[1])
