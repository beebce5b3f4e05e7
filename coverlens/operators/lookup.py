"""Left joins against summary tables, safe when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from coverlens.operators.keys import same_key
from coverlens.operators.ranges import range_number
from coverlens.operators.selection import order_statistics
from coverlens.session import BROADCAST_ROWS, materialize


@dataclass(frozen=True)
class Lookup:
    """A summary table, unique on ``keys``, whose other columns rows are to get.

    ``weight`` names the column that says how many rows share a key; the table should list every key
    that eligible rows have often. Only ``eligible`` rows (default: all) can match. ``hit`` optionally
    names a boolean "a match exists" column. ``written``: the table is stored already.
    """

    table: DataFrame
    keys: Sequence[str]
    weight: str
    hit: str | None = None
    eligible: Column | None = None
    written: bool = False

    @property
    def payload(self) -> list[str]:
        return [c for c in self.table.columns if c not in self.keys and c != self.weight]

    def able(self) -> Column:
        return F.lit(True) if self.eligible is None else F.coalesce(self.eligible, F.lit(False))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    *,
    weight: str,
    hit: str | None = None,
    eligible: Column | None = None,
    written: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach the columns of ``table`` (unique on ``keys``) to ``rows``, keeping every row.

    Only ``eligible`` rows (default: all) can match; the others get NULLs, whatever their key and
    whatever the size of ``table``. ``weight`` names the column of ``table`` that says how many rows
    share a key; ``table`` should list every key that eligible rows have often.
    The table is written once (``written``: it is already) and measured in cells: one for each
    entry and one for each element of its arrays. Up to ``broadcast_rows`` cells it is broadcast
    and ``rows`` do not move. Beyond that the heaviest keys, as many as are sure to stay within
    that number of cells, are broadcast; rows they answer, and rows that cannot match, still do
    not move, and only the others are shuffled. ``lookup_joins`` answers several tables at once.
    NULL keys match NULL keys. ``hit`` optionally names a boolean "a match exists" column.
    """
    lookup = Lookup(table, keys, weight, hit, eligible, written)
    near, light = _near(lookup, broadcast_rows)
    answered = _with_near(rows, lookup, near, "_h_")
    if light is None:
        return _resolved(rows, answered, lookup.payload, "_h_", hit)
    able = lookup.able()
    settled = F.col("_h_hit").isNotNull() | ~able
    done = _resolved(rows, answered.filter(settled), lookup.payload, "_h_", hit)
    open_rows = answered.filter(~settled).select(*rows.columns)
    light = _renamed(light, keys, lookup.payload, "_l_")
    joined = open_rows.join(light, same_key(open_rows, light, keys, "_l_k_"), "left")
    return done.unionByName(_resolved(rows, joined, lookup.payload, "_l_", hit))


def lookup_joins(
    rows: DataFrame,
    lookups: Sequence[Lookup],
    row_id: str,
    *,
    cuts: Sequence[int] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Attach several tables to ``rows`` while every row moves once at most.

    Tables within ``broadcast_rows`` cells, and the heaviest keys of the others, are broadcast, as in
    ``lookup_join``. What these leave open is asked in one routing pass over ids and keys alone: a request
    per row and open table meets the large tables in one exchange, and the answers come back to
    the row. ``row_id`` must be unique, whole and not NULL.
    Without large tables ``rows`` do not move at all. ``cuts`` (of ``equal_cuts``) asks for the rows in
    the order of ``row_id``, one partition per range; then the one exchange that orders the rows brings
    the answers too. Payload names must differ between the tables.
    """
    split = [(lookup, *_near(lookup, broadcast_rows)) for lookup in lookups]
    open_ones = [i for i, (_, _, light) in enumerate(split) if light is not None]
    out = rows
    for i, (lookup, near, _) in enumerate(split):
        out = _with_near(out, lookup, near, f"_h{i}_")

    target = None if cuts is None else range_number(F.col(row_id).cast("long"), cuts)
    if target is not None:
        out = out.withColumn("_at", target).repartitionById(len(cuts) + 1, F.col("_at"))
    if open_ones:
        answers = _answers(rows, [(i, *split[i]) for i in open_ones], row_id)
        match = ["_id"]
        out = out.withColumn("_id", F.col(row_id))
        if target is not None:
            match = ["_at", "_id"]
            answers = answers.withColumn("_at", range_number(F.col("_id").cast("long"), cuts))
            answers = answers.repartitionById(len(cuts) + 1, F.col("_at"))
        answers = answers.groupBy(*match).agg(*[F.first(f"_a{i}", ignorenulls=True).alias(f"_a{i}") for i in open_ones])
        out = out.join(answers, match, "left")
    if target is not None:  # free after a sort-merge join
        out = out.sortWithinPartitions("_at", "_id" if open_ones else row_id)

    columns = [F.col(c) for c in rows.columns]
    for i, (lookup, _, light) in enumerate(split):
        near_hit = F.col(f"_h{i}_hit").isNotNull()
        for name in lookup.payload:
            value = F.col(f"_h{i}_v_{name}")
            if light is not None:
                value = F.when(near_hit, value).otherwise(F.col(f"_a{i}")[name])
            columns.append(value.alias(name))
        if lookup.hit:
            hit = near_hit if light is None else near_hit | F.col(f"_a{i}").isNotNull()
            columns.append(hit.alias(lookup.hit))
    return out.select(*columns)


def _answers(rows: DataFrame, large: Sequence[tuple], row_id: str) -> DataFrame:
    """(_id, _a<i> per large table): one row per open request that a table can answer."""
    names = list(dict.fromkeys(k for _, lookup, _, _ in large for k in lookup.keys))
    kinds = {k: rows.schema[k].dataType for k in names}

    def key(lookup: Lookup) -> list[Column]:
        return [(F.col(k) if k in lookup.keys else F.lit(None).cast(kinds[k])).alias(f"_k_{k}") for k in names]

    asking = rows
    for i, lookup, near, _ in large:
        asking = _with_near(asking, lookup, near, f"_h{i}_", values=False)
    requests = [
        F.when(
            F.col(f"_h{i}_hit").isNull() & lookup.able(),
            F.struct(F.col(row_id).alias("_id"), F.lit(i).alias("_i"), *key(lookup)),
        )
        for i, lookup, _, _ in large
    ]
    asked = asking.select(F.explode(F.filter(F.array(*requests), lambda r: r.isNotNull())).alias("_r")).select("_r.*")

    tables = []
    for i, lookup, _, light in large:
        payload = F.struct(F.lit(True).alias("_hit"), *[F.col(c) for c in lookup.payload])
        entry = light.select(F.lit(i).alias("_j"), *[c.alias(f"_t{c_name}") for c, c_name in zip(key(lookup), names, strict=True)], payload.alias(f"_a{i}"))
        tables.append(entry)
    entries = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    same = [asked["_i"] == entries["_j"]]
    same += [asked[f"_k_{k}"].eqNullSafe(entries[f"_t{k}"]) for k in names]
    found = asked.join(entries, reduce(lambda a, b: a & b, same))
    return found.select("_id", *[f"_a{i}" for i, _, _, _ in large])


def _near(lookup: Lookup, broadcast_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The entries to broadcast, and the stored table if that leaves any."""
    table = lookup.table if lookup.written else materialize(lookup.table)
    entries, cells, widest = _measured(table, lookup.payload)
    if cells <= broadcast_rows:
        return table, None
    # The weight that fewer keys exceed than fit; found by counting, without a sort.
    fitting = broadcast_rows // widest
    cut = None
    if fitting:
        cut = order_statistics(table, [], lookup.weight, {"cut": F.lit(max(0, entries - fitting))}).first()
    heaviest = F.col(lookup.weight) > F.lit(cut["_value"]) if cut else F.lit(False)
    return table.filter(heaviest), table


def _with_near(rows: DataFrame, lookup: Lookup, near: DataFrame, tag: str, values: bool = True) -> DataFrame:
    side = _renamed(near, lookup.keys, lookup.payload if values else [], tag)
    match = same_key(rows, side, lookup.keys, f"{tag}k_") & lookup.able()
    return rows.join(F.broadcast(side), match, "left").drop(*[f"{tag}k_{k}" for k in lookup.keys])


def _measured(table: DataFrame, payload: Sequence[str]) -> tuple[int, int, int]:
    """(entries, cells, cells of the widest entry)."""
    arrays = [c for c in payload if isinstance(table.schema[c].dataType, ArrayType)]
    width = F.lit(1).cast("long")
    for name in arrays:
        width = width + F.coalesce(F.size(name), F.lit(0))
    row = table.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)), F.coalesce(F.max(width), F.lit(1))
    ).first()
    return row[0], row[1], row[2]


def _renamed(table: DataFrame, keys: Sequence[str], payload: Sequence[str], tag: str) -> DataFrame:
    return table.select(
        *[F.col(k).alias(f"{tag}k_{k}") for k in keys],
        *[F.col(c).alias(f"{tag}v_{c}") for c in payload],
        F.lit(True).alias(f"{tag}hit"),
    )


def _resolved(
    rows: DataFrame, joined: DataFrame, payload: Sequence[str], tag: str, hit: str | None
) -> DataFrame:
    columns = [*rows.columns, *[F.col(f"{tag}v_{c}").alias(c) for c in payload]]
    if hit:
        columns.append(F.col(f"{tag}hit").isNotNull().alias(hit))
    return joined.select(*columns)
