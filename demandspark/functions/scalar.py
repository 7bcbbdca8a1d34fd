"""Scalar expressions of the demand domain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinal codes of the seasonal patterns; base temperature of degree days.
PATTERN_CODES = {"summer_peak": 0, "winter_peak": 1, "shoulder_peak": 2, "year_round": 3, "irregular": 4, "undetected": 5}
BASE_TEMPERATURE = 18.0


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    """sin and cos of a 1-based position in a cycle."""
    angle = 2 * math.pi * (value - 1) / period
    return F.sin(angle), F.cos(angle)


def error_pct(error: Column, actual: Column) -> Column:
    return F.when(actual != 0, error / actual * 100)


def direction(error: Column) -> Column:
    return F.when(error > 0, "over").when(error < 0, "under").when(error == 0, "exact")


def growth(forecast_mean: Column, recent: Column) -> Column:
    return F.when(recent > 0, F.bround((forecast_mean - recent) / recent, 4))


def degree_days(temperature: Column) -> tuple[Column, Column]:
    """(cooling, heating) degree days."""
    cool, heat = temperature - BASE_TEMPERATURE, BASE_TEMPERATURE - temperature
    return F.when(cool.isNotNull(), F.greatest(cool, F.lit(0.0))), F.when(heat.isNotNull(), F.greatest(heat, F.lit(0.0)))


def months_to_peak(month: Column, peaks: Column) -> Column:
    """Months until the next peak month; NULL without peaks."""
    return F.array_min(F.transform(peaks, lambda p: F.pmod(p - month, F.lit(12))))


def pattern_code(pattern: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in PATTERN_CODES.items():
        out = F.when(pattern == name, code).otherwise(out)
    return out


def duration_months(first: Column, last: Column) -> Column:
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)


def frequency_of(median_gap_days: Column) -> Column:
    """The calendar word for a median gap between dates."""
    bands = ((2, "daily"), (10, "weekly"), (45, "monthly"), (135, "quarterly"))
    out = F.when(median_gap_days.isNull(), "unknown")
    for most, word in bands:
        out = out.when(median_gap_days <= most, word)
    return out.otherwise("yearly")
