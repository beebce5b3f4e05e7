"""Join keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "") -> Column:
    """Null-safe equality on ``keys``; ``prefix`` is put before the right-hand names."""
    tests = [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    return reduce(lambda a, b: a & b, tests)
