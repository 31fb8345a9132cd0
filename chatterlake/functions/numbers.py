"""Rounding and ratio rules that all scores share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 where whole is not positive."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def growth(current: Column, previous: Column) -> Column:
    """Relative change; from nothing it is the current value itself."""
    from_nothing = F.when(current <= 0, F.lit(0.0)).otherwise(current.cast("double"))
    return F.round(F.when(previous <= 0, from_nothing).otherwise((current - previous) / previous), 4)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def confidence(value: Column) -> Column:
    """A calibrated confidence: between 0.05 and 0.99, three digits."""
    return F.round(clamp(value, 0.05, 0.99), 3)


def rounded_mean(total: Column, n: Column, scale: int = 10_000) -> Column:
    """total / n, both whole, rounded half up to a whole number and divided by scale; total is not negative."""
    return F.floor((2 * total + n) / (2 * n)).cast("long") / scale
