"""Seasons and clocks.  The time that counts as now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import variant

#: The season's peak day north and south of the equator, and the year's length.
PEAK_NORTH, PEAK_SOUTH, YEAR_DAYS = 200, 18, 365.25


def day_distance(a: Column, b: Column, modulus: int = 366) -> Column:
    """Days between two days of the year, around the turn of the year if that is nearer."""
    d = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(d, F.lit(modulus) - d)


def seasonality(day: Column, latitude: Column) -> Column:
    """1 at the peak of the season, 0 half a year from it."""
    peak = F.when(latitude >= 0, PEAK_NORTH).otherwise(PEAK_SOUTH)
    return 0.5 + 0.5 * F.cos(2 * F.pi() * (F.dayofyear(day) - peak) / F.lit(YEAR_DAYS))


def hours_between(start: Column, end: Column, fallback: float = 12.0) -> Column:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(24.0), seconds / 3600.0))).otherwise(F.lit(fallback))


def noon(day: Column) -> Column:
    return F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))


def on_day(ts: Column, day: Column) -> Column:
    """ts lies on that day, as a half-open range, so that a scan can use it."""
    return (ts >= day.cast("timestamp")) & (ts < F.date_add(day, 1).cast("timestamp"))


def valid_date(text: Column) -> Column:
    """The date that a text of the form yyyy-MM-dd names, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def stagger_minutes(key: Column, minutes: int = 10_080) -> Column:
    """A fixed minute of the week for each key, evenly spread."""
    return variant(key, minutes)
