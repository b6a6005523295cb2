"""Rounding and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 1/2) / 10^digits: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def days_between(earlier: Column, later: Column) -> Column:
    """Days with their fraction; also for timestamps without a zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)


def months_between_calendar(earlier: Column, later: Column) -> Column:
    """Difference of the calendar months; days don't count."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent(part: Column, whole: Column) -> Column:
    """Text with one decimal; `0%` of nothing."""
    return F.when(whole == 0, "0%").otherwise(F.format_string("%.1f%%", F.try_divide(part * 100.0, whole)))
