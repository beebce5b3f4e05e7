"""Exact order statistics without sorting: medians and quantile buckets of any size of group.

A rank is located by counting, not by sorting. One pass counts rows per (group, bucket) of a
monotone bucket function; partial aggregation keeps what is shuffled to a few thousand rows per
group and task. The buckets that hold the wanted ranks are then re-counted at finer steps until
they are small, and only their distinct values are ordered. No task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.operators.keys import same_key
from coverlens.session import BROADCAST_ROWS, materialize

_STEPS_PER_OCTAVE = 1024
_REFINE_STEPS = 4096
# Above every bucket of a number: 1024 octaves on either side of 1.
_NAN_BUCKET = 1 << 30


def _coarse_bucket(value: Column) -> Column:
    """Monotone bucket number on a signed log scale, NaN last; a pure function of the value."""
    number = value.cast("double")
    magnitude = F.log2(F.lit(1.0) + F.least(F.abs(number), F.lit(1.7e308)))
    bucket = F.floor(F.signum(number) * magnitude * F.lit(float(_STEPS_PER_OCTAVE)))
    return F.when(F.isnan(number), F.lit(_NAN_BUCKET).cast("long")).otherwise(bucket)


def _counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("_w").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Mapping[str, Column],
    *,
    weight: str | None = None,
    levels: Sequence[int] | None = None,
    refine_rows: int = 2_000_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The value at given 0-based ranks of each group.

    ``positions`` maps a name to a rank, written with ``F.col("_n")`` (non-NULL values in the
    group) and the key columns. Returns ``keys, _n, _pos, _rank, _less, _value`` with ``_less``
    the number of smaller values; ranks outside the group give no row. ``weight`` optionally
    names how many times a row counts. NaN is larger than any number.

    ``levels`` asks for groups by the first so many keys at once, 0 for the whole table; the result then
    starts with ``_level``, and keys beyond a level are NULL. The histogram is counted at the finest
    level and rolled up; rows enter it once, whatever the number of levels.
    ``df`` is read twice at most: for the histogram, and for what lies in the buckets it points out.
    """
    keys = list(keys)
    rows = df.select(
        *keys,
        F.col(value).alias("_v"),
        _coarse_bucket(F.col(value)).alias("_bucket"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"),
    ).filter(F.col("_v").isNotNull())

    histogram = _counted(rows, [*keys, "_bucket"])
    finest = keys
    if levels is not None:
        histogram = _rolled_up(materialize(histogram), keys, levels)
        keys = ["_level", *keys]
    # Per group this window sees one row per bucket: bounded by the exponent range, not the data.
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("_pos"), rank.cast("long").alias("_rank"))
            for name, rank in positions.items()
        ]
    )
    targets = (
        histogram.withColumn("_n", F.sum("_rows").over(group))
        .withColumn("_less", F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
        .withColumn("_want", F.explode(ranks))
        .select("*", "_want._pos", "_want._rank")
        .drop("_want")
    )
    targets = materialize(_holding_rank(targets))

    carried = [*keys, "_pos", "_rank", "_n", "_bucket"]
    found, widest = _extent(targets)
    before_that = None
    if levels is not None and widest:
        # one row per value of a finest group enters once per level
        located = _combined(_located(rows, targets, ["_bucket"], found, broadcast_rows), finest)
        rows = _entered(materialize(located), finest, levels)
    elif widest > refine_rows:
        rows = materialize(_combined(_located(rows, targets, [*keys, "_bucket"], found, broadcast_rows), keys))
    # Finer until small, or until a step parts nothing any more: the rest are few distinct values.
    while widest > refine_rows and widest != before_that:
        before_that = widest
        inside = _inside(rows, targets, keys, found, broadcast_rows)
        width = (F.col("_hi") - F.col("_lo")).cast("double")
        step = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * _REFINE_STEPS)
        inside = inside.withColumn("_step", F.coalesce(step, F.lit(0))).drop("_lo", "_hi")
        finer = _counted(inside, [*carried, "_base", "_step"])
        upto = Window.partitionBy(*keys, "_pos").orderBy("_step")
        upto = upto.rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("_base") + F.coalesce(F.sum("_rows").over(upto), F.lit(0))
        targets = materialize(_holding_rank(finer.withColumn("_less", before)).drop("_base", "_step"))
        found, widest = _extent(targets)

    answer = [*keys, "_n", "_pos", "_rank", "_less"]
    if widest == 0:  # every located bucket holds a single distinct value
        return targets.select(*answer, F.col("_lo").alias("_value"))
    inside = _inside(rows, targets, keys, found, broadcast_rows)
    values = inside.groupBy(*carried, "_base", "_v").agg(F.sum("_w").alias("_rows"))
    upto = Window.partitionBy(*keys, "_pos").orderBy("_v")
    upto = upto.rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_rows").over(upto), F.lit(0))
    return _holding_rank(values.withColumn("_less", before)).select(
        *answer, F.col("_v").alias("_value")
    )


def _entered(rows: DataFrame, keys: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """``rows`` once per level, with the keys beyond it set to NULL."""
    at = F.array(
        *[
            F.struct(
                F.lit(depth).alias("_level"),
                *[
                    (F.col(k) if i < depth else F.lit(None).cast(rows.schema[k].dataType)).alias(k)
                    for i, k in enumerate(keys)
                ],
            )
            for depth in levels
        ]
    )
    others = [c for c in rows.columns if c not in keys]
    return rows.select(*others, F.explode(at).alias("_at")).select("_at.*", *others)


def _rolled_up(histogram: DataFrame, keys: Sequence[str], levels: Sequence[int]) -> DataFrame:
    return _entered(histogram, keys, levels).groupBy("_level", *keys, "_bucket").agg(
        F.sum("_rows").alias("_rows"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )


def _located(
    rows: DataFrame, targets: DataFrame, names: Sequence[str], found: int, broadcast_rows: int
) -> DataFrame:
    """The rows of any bucket in ``targets``, told by ``names`` alone."""
    side = targets.select(*[F.col(n).alias(f"_t_{n}") for n in names]).distinct()
    if found <= broadcast_rows:
        side = F.broadcast(side)
    return rows.join(side, same_key(rows, side, names, "_t_"), "left_semi")


def _combined(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal values of a group as one row."""
    return rows.groupBy(*keys, "_bucket", "_v").agg(F.sum("_w").alias("_w"))


def _holding_rank(counted: DataFrame) -> DataFrame:
    rank, less = F.col("_rank"), F.col("_less")
    return counted.filter((rank >= less) & (rank < less + F.col("_rows")))


def _extent(targets: DataFrame) -> tuple[int, int]:
    """(number of located buckets, rows in the largest one that is not a single value)."""
    undecided = F.when(F.col("_lo") < F.col("_hi"), F.col("_rows"))
    row = targets.agg(F.count(F.lit(1)), F.coalesce(F.max(undecided), F.lit(0))).first()
    return row[0], row[1]


def _inside(
    rows: DataFrame, targets: DataFrame, keys: Sequence[str], found: int, broadcast_rows: int
) -> DataFrame:
    """The rows that lie in a located bucket, with its rank and bounds."""
    side = targets.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        F.col("_bucket").alias("_t__bucket"),
        "_pos",
        "_rank",
        "_n",
        F.col("_less").alias("_base"),
        "_lo",
        "_hi",
    )
    if found <= broadcast_rows:
        side = F.broadcast(side)
    else:  # many groups: combine equal values before anything is shuffled to the join
        rows = _combined(rows, keys)
    match = same_key(rows, side, [*keys, "_bucket"], "_t_")
    match = match & rows["_v"].between(side["_lo"], side["_hi"])
    return rows.join(side, match).drop(*[f"_t_{k}" for k in keys], "_t__bucket")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **options
) -> DataFrame:
    """``keys, name, _n``: the interpolated median per group and how many values it rests on.

    With ``levels`` also ``_level``, as in ``order_statistics``.
    """
    n = F.col("_n")
    picked = order_statistics(
        df, keys, value, {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)}, **options
    )
    keys = list(keys) if options.get("levels") is None else ["_level", *keys]
    wide = picked.groupBy(*keys).agg(
        F.max(F.when(F.col("_pos") == "lower", F.col("_value"))).alias("_lower"),
        F.max(F.when(F.col("_pos") == "upper", F.col("_value"))).alias("_upper"),
        F.max("_n").alias("_n"),
    )
    between = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * F.lit(0.5)
    # equal neighbours may be infinite
    middle = F.when(F.col("_lower") == F.col("_upper"), F.col("_lower")).otherwise(between)
    return wide.select(*keys, middle.alias(name), "_n")


def ntile_expression(df: DataFrame, value: str, row_id: str, buckets: int, **options) -> Column:
    """Bucket number 1..``buckets`` of each row of ``df`` ordered by ``(value, row_id)``.

    Same sizes as SQL ``ntile``: they differ by at most one and the larger ones come first.
    Only the ``buckets - 1`` cut points are looked up (and fetched, they become literals of the
    returned expression); the rows themselves are neither sorted nor moved. ``row_id`` must be
    unique: it decides between rows of equal value.
    """
    n = F.col("_n")
    size, extra = F.floor(n / buckets), n % buckets
    starts = {str(c): c * size + F.least(F.lit(c), extra) for c in range(1, buckets)}
    if not starts:
        return F.lit(1).cast("long")
    at_value = order_statistics(df, [], value, starts, **options).select(
        F.col("_pos").alias("_cut"),
        F.col("_value").alias("_cut_value"),
        (F.col("_rank") - F.col("_less")).alias("_skip"),
    )
    at_value = materialize(at_value)
    # at most buckets - 1 rows
    tied = df.join(F.broadcast(at_value), df[value] == at_value["_cut_value"])
    at_row = order_statistics(
        tied, ["_cut", "_cut_value", "_skip"], row_id, {"start": F.col("_skip")}, **options
    )
    bucket = F.lit(1)
    for cut in at_row.select("_cut_value", "_value").collect():
        edge, first_id = F.lit(cut["_cut_value"]), F.lit(cut["_value"])
        beyond = (F.col(value) > edge) | ((F.col(value) == edge) & (F.col(row_id) >= first_id))
        bucket = bucket + F.when(beyond, 1).otherwise(0)
    return bucket.cast("long")
