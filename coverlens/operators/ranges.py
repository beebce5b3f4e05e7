"""Cutting a numbering into ranges of equally many rows, by counting.

The numbers may start anywhere and have gaps of any size. A histogram over their extent finds the
buckets in which a range ends, and only these are counted again, finer, until each end is one number. What
the driver holds is bounded: the counts of one histogram and one number per range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 65_536
OUTSIDE = None
_TREE_CUTS = 63


def equal_cuts(
    df: DataFrame,
    position: str,
    every: int | Callable[[int], int],
    *,
    extent: tuple[int, int] | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """The first number of every range but the first, ascending, such that a range has ``every`` rows.

    ``every`` may be told by a function of the number of rows. The last range may have fewer. ``position`` is a whole number; rows without one are not counted.
    Where it repeats, equal numbers stay together, so that a range may differ by their count and a cut may
    be missing. ``extent`` (least, greatest) spares the pass that finds them; numbers outside it bring
    that pass back. Every pass reads the one column; there is one per factor of
    ``buckets`` / ranges in the extent, fewer where numbers are dense.
    """
    rows = df.select(F.col(position).cast("long").alias("_p")).filter(F.col("_p").isNotNull())
    if extent is None:
        low, high = rows.agg(F.min("_p"), F.max("_p")).first()
        if low is None:
            return []
    else:
        low, high = extent
    step = max(1, -(-(high - low + 1) // buckets))
    counted = _histogram(rows, [low], high - low + 1, step)
    if counted.pop(OUTSIDE, None):
        return equal_cuts(df, position, every, buckets=buckets)
    total = sum(n for own in counted.values() for _, n in own)
    every = every(total) if callable(every) else every
    located = _locate(counted, {low: 0}, step, every, total)
    while located and step > 1:
        starts = sorted(located)
        inner = max(1, -(-step // max(2, buckets // len(starts))))
        counted = _histogram(rows, starts, step, inner)
        counted.pop(OUTSIDE, None)
        located, step = _locate(counted, located, inner, every, total), inner
    return sorted(located)


def _longs(numbers: Sequence[int]) -> Column:
    """A constant array: one literal to the client however long it is, folded once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _histogram(rows: DataFrame, starts: Sequence[int], width: int, step: int) -> dict[int | None, list[tuple[int, int]]]:
    """start -> (number, rows) of its buckets, ascending; what is in no [start, start + width) is OUTSIDE."""
    start = F.get(_longs(starts), range_number(F.col("_p"), starts) - 1)
    placed = rows.select("_p", start.alias("_s"))
    inside = F.col("_p") < F.col("_s") + F.lit(width)
    placed = placed.select("_p", F.when(inside, F.col("_s")).alias("_s"))
    counts = placed.groupBy("_s", F.expr(f"(_p - _s) div {step}").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    out: dict[int | None, list[tuple[int, int]]] = {}
    for row in sorted(counts.collect(), key=lambda r: (r["_s"] is None, r["_s"], r["_b"])):
        out.setdefault(row["_s"], []).append((row["_b"], row["_n"]))
    return out


def _locate(
    counted: dict[int | None, list[tuple[int, int]]], before: dict[int, int], step: int, every: int, total: int
) -> dict[int, int]:
    """start -> rows before it, of the buckets that hold the first row of a later range."""
    out = {}
    for start, own in counted.items():
        reached = accumulate((n for _, n in own), initial=before[start])
        for (bucket, n), less in zip(own, reached, strict=False):
            first = max(every, -(-less // every) * every)
            if first < min(less + n, total):
                out[start + bucket * step] = less
    return out


def range_number(position: Column, cuts: Sequence[int]) -> Column:
    """How many ``cuts`` (ascending) are at most ``position``: the number of its range, from 0.

    A search by halving inside one expression, so that a row costs the logarithm of their number: few
    cuts are a tree of comparisons that compiles, many a constant array. A missing position belongs to
    the first range.
    """
    if len(cuts) <= _TREE_CUTS:
        return _tree(position, cuts, 0)
    table, steps = _longs(cuts), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.get(table, at + step - 1) <= position, step).otherwise(0),
    )
    return F.when(position.isNull(), 0).otherwise(found)


def _tree(position: Column, cuts: Sequence[int], before: int) -> Column:
    if not cuts:
        return F.lit(before)
    middle = len(cuts) // 2
    above = _tree(position, cuts[middle + 1 :], before + middle + 1)
    return F.when(position >= F.lit(cuts[middle]), above).otherwise(_tree(position, cuts[:middle], before))
