"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(ts: Column) -> Column:
    return F.year(ts).cast("long")


def month_number(ts: Column) -> Column:
    """Months since year 0; differences count month *boundaries*, not whole months."""
    return F.year(ts) * 12 + F.month(ts)


def months_apart(earlier: Column, later: Column) -> Column:
    """Month boundaries crossed: Jan 31 -> Feb 1 is 1."""
    return month_number(later) - month_number(earlier)
