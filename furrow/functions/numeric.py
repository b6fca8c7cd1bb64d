"""Null-aware numeric expressions.

Missing numbers are NULL everywhere in this package. NaN is turned into NULL where data enters,
because Spark orders NaN above every number and lets it spread through ``avg`` and ``sum``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite_or_null(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.abs(value) < F.lit(_INF), value)


def measure(value: Column) -> Column:
    """A measured value read from any column type: double, unreadable text or NaN as NULL."""
    return nan_to_null(value.try_cast("double"))


def guarded_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.when(denominator == 0, F.lit(default)).otherwise(F.try_divide(numerator, denominator))


def null_safe_max(value: Column, floor: float = 0.0) -> Column:
    """``max(floor, value)`` that stays NULL for NULL (``greatest`` skips NULL)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(floor), value))


def mean_of_present(a: Column, b: Column) -> Column:
    """Mean of two values over those that are present."""
    return (F.coalesce(a, b) + F.coalesce(b, a)) / 2


def flag(condition: Column) -> Column:
    """A condition in which NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def saturation_vapour_pressure(celsius: Column) -> Column:
    """Tetens equation, kPa."""
    return 0.6108 * F.exp((17.27 * celsius) / (celsius + 237.3))


def vapour_pressure_deficit(celsius: Column, humidity: Column) -> Column:
    """kPa, never negative; NULL without temperature or humidity."""
    saturated = saturation_vapour_pressure(celsius)
    return null_safe_max(saturated - saturated * (humidity / 100.0))


def scaled_index(value: Column) -> Column:
    """Vegetation index from an 8-bit level."""
    return value / 255.0 * 2.0 - 1.0
