"""Null-safe arithmetic and flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is zero or either side is null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_half_even(x: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def clip(x: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; unlike bare greatest/least a null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def flag(cond: Column) -> Column:
    """0/1, with unknown counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def any_flag(cond: Column) -> Column:
    """Aggregate: 1 if the condition held on any row of the group."""
    return F.max(flag(cond))


def count_where(cols: Iterable[Column]) -> Column:
    """How many of the given conditions hold on this row."""
    total = F.lit(0)
    for c in cols:
        total = total + flag(c)
    return total


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
