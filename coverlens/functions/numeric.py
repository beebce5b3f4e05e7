"""Rounding and ratios that agree with IEEE-double SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero after scaling in binary.

    ``F.round(x, n)`` goes through the decimal text of ``x`` (1.005 -> 1.01); scaling first
    keeps the result a plain double operation (1.005 -> 1.0).
    """
    if digits == 0:
        return F.round(value, 0)
    scale = 10.0**digits
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` in doubles, NULL where the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` as a rounded percentage of ``whole``."""
    return round_to(safe_ratio(F.lit(100.0) * part, whole), digits)
