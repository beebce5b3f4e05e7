"""Medians by ever coarser groups, and filling values from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.lookup import Lookup, lookup_join
from coverlens.operators.selection import exact_median
from coverlens.session import BROADCAST_ROWS, materialize


def fallback_medians(
    df: DataFrame, value: str, keys: Sequence[str], plausible: tuple[float, float]
) -> DataFrame:
    """Median of plausible values for every prefix of ``keys``, down to the whole table.

    Returns ``_level, keys, median, _n``; level ``len(keys)`` is the finest, 0 the whole table,
    and keys beyond a level are NULL. All levels come from one histogram, counted at the finest.
    """
    rows = df.filter(F.col(value).between(*plausible))
    return exact_median(rows, keys, value, levels=range(len(keys) + 1))


def median_lookups(
    medians: DataFrame, keys: Sequence[str], *, min_cell: int, overall_digits: int = 6
) -> tuple[list[Lookup], Column]:
    """Lookups of the levels' medians that rest on ``min_cell`` values, and the finest one found.

    The second is a column over a row that the lookups' columns were attached to; without any it is
    the overall median.
    """
    medians = materialize(medians)
    whole = medians.filter(F.col("_level") == 0).select("median").first()  # a single row
    best = [F.lit(float(f"{whole[0]:.{overall_digits}f}") if whole else None).cast("double")]
    lookups = []
    for depth in range(1, len(keys) + 1):
        used = list(keys[:depth])
        cell = medians.filter((F.col("_level") == depth) & (F.col("_n") >= min_cell))
        for key in used:
            cell = cell.filter(F.col(key).isNotNull())
        cell = cell.select(*used, F.col("median").alias(f"_median{depth}"), "_n")
        lookups.append(Lookup(cell, used, "_n", written=True))
        best.insert(0, F.col(f"_median{depth}"))
    return lookups, F.coalesce(*best)


def impute_from_medians(
    df: DataFrame,
    medians: DataFrame,
    keys: Sequence[str],
    *,
    min_cell: int,
    overall_digits: int = 6,
    name: str = "median",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach the finest median that rests on ``min_cell`` values, else the overall one.

    A NULL key never selects a group; that row falls back to the next coarser level.
    """
    lookups, best = median_lookups(medians, keys, min_cell=min_cell, overall_digits=overall_digits)
    out = df
    for cell in lookups:
        out = lookup_join(
            out, cell.table, cell.keys, weight=cell.weight, written=True, broadcast_rows=broadcast_rows
        )
    return out.select(*df.columns, best.alias(name))
