"""Collapsing related records into projects: one link, one fixed time window, one project.

Windows are anchored at the first date of a link and never slide: record ``m`` months after that
date belongs to window ``floor(m / N)``. The earliest record of a window stands for the project.

A link may hold any share of the rows, so nothing is ranked row by row. Rows are first combined
per (link, calendar month) -- on the map side -- which leaves at most one entry per month of the
calendar for each link; all windows run on those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions import month_number
from coverlens.operators.lookup import Lookup, lookup_join
from coverlens.session import BROADCAST_ROWS


@dataclass(frozen=True)
class ProjectRule:
    link: str = "TTS_link_ID"
    date: str = "installation_date"
    tie_break: Sequence[str] = ("PV_system_size_DC", "data_provider_1", "system_ID_1")
    window_months: int = 12
    missing: Sequence[str] = schema.UNKNOWN_TEXT
    # SQL semantics by default: NULL is no missing code, so NULL links form one group.
    null_is_missing: bool = False

    def linked(self) -> Column:
        return F.coalesce(~F.col(self.link).isin(*self.missing), F.lit(not self.null_is_missing))

    def collapsible(self) -> Column:
        """Rows that can be part of a multi-row project; all others stand alone."""
        if self.window_months <= 0:
            return F.lit(False)
        return self.linked() & F.col(self.date).isNotNull()


def _months(df: DataFrame, rule: ProjectRule, *extra: Column) -> DataFrame:
    """One row per (link, month): earliest date, row count and whatever ``extra`` aggregates."""
    return df.groupBy(
        F.col(rule.link).alias("_link"), month_number(F.col(rule.date)).alias("_month")
    ).agg(F.min(rule.date).alias("_first"), F.count(F.lit(1)).alias("_rows"), *extra)


def _head(rule: ProjectRule, payload: Sequence[str]) -> Column:
    """Orders rows by date and tie-break with NULLs last; carries ``payload`` along."""
    parts = [F.col(rule.date).alias("_0")]
    for i, name in enumerate(rule.tie_break, start=1):
        parts += [F.col(name).isNull().alias(f"_null{i}"), F.col(name).alias(f"_{i}")]
    return F.struct(*parts, *[F.col(c).alias(c) for c in payload])


def _windows(months: DataFrame, rule: ProjectRule) -> DataFrame:
    """One row per (link, window)."""
    offset = F.col("_month") - F.min("_month").over(Window.partitionBy("_link"))
    return (
        months.withColumn("_window", F.floor(offset / rule.window_months))
        .groupBy("_link", "_window")
        .agg(
            F.min("_head").alias("_head"),
            F.min("_first").alias("_first"),
            F.sum("_rows").alias("_rows"),
        )
    )


def first_of_project(df: DataFrame, rule: ProjectRule, payload: Sequence[str]) -> DataFrame:
    """``payload`` of the row that stands for each multi-row-capable project.

    Rows outside ``rule.collapsible()`` are not included: each of them is a project of its own.
    """
    rows = df.filter(rule.collapsible())
    months = _months(rows, rule, F.min(_head(rule, payload)).alias("_head"))
    return _windows(months, rule).select(*[F.col(f"_head.{c}").alias(c) for c in payload])


def project_lookup(
    df: DataFrame, rule: ProjectRule, row_id: str, first: str = "first_at_address"
) -> tuple[Lookup, Column]:
    """The links of ``df`` with their earliest date ``first`` and project heads; and the flag made of them.

    The flag is a column over a row that the lookup's columns were attached to: this row stands for its
    project. Rows that cannot share one are only counted per link; heads are sought among the others.
    """
    able = rule.linked() & F.col(rule.date).isNotNull()
    if rule.window_months > 0:
        head = F.min(_head(rule, [row_id])).alias("_head")
        entries = _windows(_months(df.filter(able), rule, head), rule)
        rest = df.filter(~able)
        heads = [F.collect_list(f"_head.{row_id}").alias("_heads")]  # one per window of the calendar
        is_head = F.array_contains("_heads", F.col(row_id))
    else:
        entries, rest, heads, is_head = None, df, [], F.lit(True)
    alone = rest.groupBy(F.col(rule.link).alias("_link")).agg(
        F.min(rule.date).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    entries = alone if entries is None else entries.drop("_window").unionByName(alone, allowMissingColumns=True)
    links = entries.groupBy(F.col("_link").alias(rule.link)).agg(
        F.min("_first").alias(first), F.sum("_rows").alias("_rows"), *heads
    )
    return Lookup(links, [rule.link], "_rows"), F.when(able, is_head).otherwise(True)


def flag_projects(
    df: DataFrame,
    rule: ProjectRule,
    row_id: str,
    *,
    flag: str = "is_first_at_address",
    first: str = "first_at_address",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add ``first`` (earliest date at the link) and ``flag`` (this row stands for its project).

    ``row_id`` must be unique; it settles ties that the rule leaves open. Rows meet one summary
    row per link, which lists the project heads of that link; links without a dated row are in that
    table too, so that no key of any size is left to the shuffle. Missing codes are links there:
    their rows get the earliest date of their code, as in SQL, and always stand alone.
    """
    links, stands = project_lookup(df, rule, row_id, first)
    joined = lookup_join(df, links.table, links.keys, weight=links.weight, broadcast_rows=broadcast_rows)
    return joined.select(*df.columns, first, stands.alias(flag))


def window_sensitivity(df: DataFrame, rule: ProjectRule, windows: Sequence[int]) -> DataFrame:
    """Rows and projects for every window length, from one scan.

    After combining per (link, month), a month opens a new project of window ``N`` when its
    window number differs from the previous month's. Returns ``_window, systems, projects``.
    """
    usable = rule.linked() & F.col(rule.date).isNotNull()
    months = df.groupBy(
        usable.alias("_linked"),
        F.when(usable, F.col(rule.link)).alias("_link"),
        F.when(usable, month_number(F.col(rule.date))).alias("_month"),
    ).agg(F.count(F.lit(1)).alias("_rows"))
    link = Window.partitionBy("_linked", "_link")
    months = months.withColumn("_start", F.min("_month").over(link)).withColumn(
        "_previous", F.lag("_month").over(link.orderBy("_month"))
    )

    def window_of(month: str, n: int) -> Column:
        return F.floor((F.col(month) - F.col("_start")) / n)

    def projects(n: int) -> Column:
        if n <= 0:
            return F.sum("_rows")
        opens = ~window_of("_month", n).eqNullSafe(window_of("_previous", n))
        return F.sum(F.when(~F.col("_linked"), F.col("_rows")).otherwise(opens.cast("long")))

    wide = months.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("systems"),
        *[F.coalesce(projects(n), F.lit(0)).alias(f"_p{n}") for n in windows],
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("_window"), F.lit(i).alias("_order"), F.col(f"_p{n}").alias("projects"))
            for i, n in enumerate(windows)
        ]
    )
    return (
        wide.select("systems", F.explode(cells).alias("_cell"))
        .select("_cell._window", "_cell._order", "systems", "_cell.projects")
    )
