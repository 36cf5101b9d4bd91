"""Time expressions. All differences are exact microseconds, never calendar boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
NEVER = 9999
# fixed value: seconds beyond this bound are outside the supported calendar and become null
UNIX_BOUND = 9_200_000_000


def unix_seconds_to_ts(seconds: Column) -> Column:
    ok = seconds.between(-UNIX_BOUND, UNIX_BOUND)
    return F.when(ok, F.timestamp_seconds(seconds))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``; null if either is null."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(DAY_MICROS))


def round_days(days: Column) -> Column:
    """Half-even rounding to whole days."""
    return F.rint(days).cast("int")


def days_ago(t: Column, at: Column) -> Column:
    """Rounded age in days; an event after ``at`` has no age."""
    age = round_days(days_between(t, at))
    return F.when(age >= 0, age)


def days_since(t: Column, at: Column) -> Column:
    """Rounded age in days, never below zero; null stays null (the fill decides)."""
    age = days_between(t, at)
    return round_days(F.when(age < 0, F.lit(0.0)).otherwise(age))


def whole_days(t: Column, at: Column) -> Column:
    """Completed days (floor), which may be negative."""
    return F.floor(days_between(t, at)).cast("int")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5
