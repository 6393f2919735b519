"""Rounding and ratio rules shared by every report.

Half-up rounding is ``floor(x + 0.5)``; ``round`` differs from it at negative ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

SAFE_INTEGER = 2**53 - 1


def half_up(x: Column) -> Column:
    """Nearest integer, ties towards plus infinity (BIGINT)."""
    return F.floor(x + F.lit(0.5))


def fixed(x: Column, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals, never minus zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, null when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def saved_percent(original: Column, output: Column, when_empty: float | None = None) -> Column:
    """Saved share of the original in percent, one decimal.

    Progress reports give null for an empty original, target reports give 0.
    """
    value = fixed(share(original - output, original) * F.lit(100.0), 1)
    return F.when((original > 0) & (output >= 0), value).otherwise(F.lit(when_empty).cast("double"))


def exact_sum(x: Column) -> Column:
    """Sum doubles as decimals so that the result does not depend on task order."""
    return F.sum(x.cast("decimal(28,6)"))


def exact_mean(x: Column, digits: int = 3) -> Column:
    """Order-independent mean, rounded."""
    return fixed(share(exact_sum(x), F.count(x)), digits)


def size_in_bytes(value: Column, unit: Column) -> Column:
    """A size in KB, MB or GB as whole bytes; null if it isn't positive, finite and exact."""
    amount = value.cast("double")
    base = dims.lookup(unit, dims.SIZE_UNITS)
    whole = F.floor(amount * base + 0.5)
    fits = (amount > 0) & ~F.isnan(amount) & (amount * base <= SAFE_INTEGER) & (whole > 0)
    return F.when(fits, whole.cast("bigint"))


def bytes_in_unit(size: Column, unit: Column) -> Column:
    """A number of bytes in KB, MB or GB; null if negative."""
    return F.when(size >= 0, size.cast("double") / dims.lookup(unit, dims.SIZE_UNITS))
