"""Scalar functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """x within bounds; a null x stays null."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNotNull(), out)


def add(a: Column, b: Column) -> Column:
    """a + b, of which a null counts as none; null if both are."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def subtract(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def carbon_tons(x: Column) -> Column:
    return F.bround(x + F.lit(1e-12), 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def thi(temperature: Column, humidity: Column) -> Column:
    """Temperature-humidity index."""
    return 0.81 * temperature + 0.01 * humidity * (0.99 * temperature - 14.3) + 46.3


def cooling_degrees(t: Column, base: float = 24.0) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), t - base))


def heating_degrees(t: Column, base: float = 18.0) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), base - t))


def grade(score: Column) -> Column:
    return F.when(score >= 80, "GOOD").when(score >= 60, "FAIR").when(score >= 40, "POOR").when(score.isNotNull(), "BAD")


def finite(x: Column) -> Column:
    """Null for what JSON cannot hold (NaN and infinities)."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
