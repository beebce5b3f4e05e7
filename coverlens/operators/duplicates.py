"""Exact copies: same link, same size, same price."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.operators.lookup import Lookup, lookup_join
from coverlens.session import BROADCAST_ROWS


@dataclass(frozen=True)
class DuplicateRule:
    link: str = "TTS_link_ID"
    price: str = "total_installed_price"
    keys: Sequence[str] = ("TTS_link_ID", "PV_system_size_DC", "total_installed_price")
    missing: Sequence[str] = schema.UNKNOWN_TEXT

    def excluded(self) -> Column:
        """No real link or no real price. A NULL is neither, as in SQL."""
        no_link = F.coalesce(F.col(self.link).isin(*self.missing), F.lit(False))
        return no_link | F.coalesce(F.col(self.price) <= 0, F.lit(False))


def copies_lookup(df: DataFrame, rule: DuplicateRule, flag: str = "exact_duplicate") -> Lookup:
    """Keys that two or more rows of ``df`` share; ``flag`` is the lookup's hit.

    Counting is a grouped aggregate with map-side combine, and only keys seen more than once
    travel back, so a group of copies of any size is never gathered in one place.
    """
    copies = (
        df.filter(~rule.excluded())
        .groupBy(*rule.keys)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .filter(F.col("_copies") > 1)
    )
    return Lookup(copies, list(rule.keys), "_copies", hit=flag, eligible=~rule.excluded())


def flag_exact_duplicates(
    df: DataFrame,
    rule: DuplicateRule,
    *,
    flag: str = "exact_duplicate",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add a boolean: at least one other row agrees on all of ``rule.keys``."""
    found = copies_lookup(df, rule, flag)
    return lookup_join(
        df,
        found.table,
        found.keys,
        weight=found.weight,
        hit=flag,
        eligible=found.eligible,
        broadcast_rows=broadcast_rows,
    )
