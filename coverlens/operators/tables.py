"""Grouped report tables: coverage, distributions, cross-tabs, growth, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.functions import round_to, safe_ratio, share
from coverlens.operators.keys import same_key
from coverlens.operators.selection import exact_median

# Amounts are kept raw in the intermediate columns; a code or a 0 is NULL there, so plain
# count / sum / avg already mean "over the rows that report it".


def measures(df: DataFrame, kw: str = "PV_system_size_DC", price: str = "total_installed_price") -> DataFrame:
    """Add ``kw``, ``usd`` (reported price) and ``usd_kw`` (size of the rows that report one)."""
    usd = F.when(F.col(price) > 0, F.col(price))
    return df.withColumns(
        {"kw": F.col(kw), "usd": usd, "usd_kw": F.when(usd.isNotNull(), F.col(kw))}
    )


class totals:
    """The aggregates most reports share, over the columns that ``measures`` adds."""

    @staticmethod
    def rows() -> Column:
        return F.count(F.lit(1))

    @staticmethod
    def mw(kw: str = "kw") -> Column:
        return round_to(F.sum(kw) / 1000.0, 1)

    @staticmethod
    def musd(usd: str = "usd", digits: int = 1) -> Column:
        return round_to(F.sum(usd) / 1e6, digits)

    @staticmethod
    def usd_per_watt() -> Column:
        return round_to(safe_ratio(F.sum("usd"), F.sum("usd_kw") * 1000.0), 2)


def coverage(
    df: DataFrame, fields: Mapping[str, Column], by: Sequence[str] = (), count_as: str = "rows"
) -> DataFrame:
    """Percentage of rows that pass each validity test, over everything or per group."""
    aggregates = [totals.rows().alias(count_as)]
    aggregates += [share(F.count_if(ok), totals.rows()).alias(name) for name, ok in fields.items()]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def with_median(
    report: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    digits: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Join the exact median of ``value`` to a table that has one row per ``keys``."""
    medians = exact_median(rows, keys, value, name, weight=weight).drop("_n")
    shown = F.col(name) if digits is None else round_to(F.col(name), digits)
    medians = medians.select(*[F.col(k).alias(f"_m_{k}") for k in keys], shown.alias(name))
    return report.join(medians, same_key(report, medians, keys, "_m_"), "left").drop(
        *[f"_m_{k}" for k in keys]
    )


def band_distribution(sizes: DataFrame, band: str) -> DataFrame:
    """Per band: counts, shares, running totals, capacity, median size and price.

    ``sizes`` has a row per size ``kw`` with its counts ``n_sized`` and ``n_priced`` and its sums
    ``kw_sum``, ``usd`` and ``usd_kw``. The windows run over the finished groups only, one row per
    label of the ladder.
    """
    grouped = sizes.groupBy(band).agg(
        F.sum("n_sized").alias("n_systems"),
        F.sum("kw_sum").alias("_kw"),
        F.sum("n_priced").alias("n_priced"),
        totals.musd().alias("capital_musd"),
        totals.usd_per_watt().alias("usd_per_watt"),
    )
    grouped = with_median(grouped, sizes, [band], "kw", "median_kw", 1, weight="n_sized")
    everything = Window.partitionBy()
    running = Window.orderBy(F.asc_nulls_last(band))
    total = F.sum("n_systems").over(everything)
    so_far = F.sum("n_systems").over(running)
    return grouped.select(
        band,
        "n_systems",
        share(F.col("n_systems"), total, 2).alias("pct_systems"),
        so_far.alias("cum_systems"),
        share(so_far, total, 1).alias("cum_pct_systems"),
        round_to(F.col("_kw") / 1000.0, 1).alias("mw_dc"),
        share(F.col("_kw"), F.sum("_kw").over(everything), 2).alias("pct_mw"),
        "median_kw",
        "n_priced",
        "capital_musd",
        "usd_per_watt",
    )


def cross_tab(column: Column, values: Mapping[str, object]) -> list[Column]:
    """One filtered row count per value: {output name: value}."""
    return [F.count_if(column == F.lit(v)).alias(name) for name, v in values.items()]


def growth(rows: DataFrame, key: str, amount: str, year: str, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Rows, and per named span of years the row count and the sum of ``amount``."""
    aggregates = [totals.rows().alias("_rows")]
    for name, (start, end) in spans.items():
        inside = F.col(year).between(start, end)
        aggregates += [
            F.count_if(inside).alias(f"_n_{name}"),
            F.sum(F.when(inside, F.col(amount))).alias(f"_sum_{name}"),
        ]
    return rows.groupBy(key).agg(*aggregates)


def gap_report(
    found: DataFrame, key: str, reference: Sequence[str], count: str, labels: tuple[str, str, str], thin: int
) -> DataFrame:
    """Every value of a reference list with what was found for it and a status.

    ``labels`` are (absent, thin, covered). The list is a literal relation.
    """
    spark = found.sparkSession
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in reference])).alias(key))
    absent, few, covered = labels
    status = (
        F.when(F.col(count).isNull(), absent).when(F.col(count) < thin, few).otherwise(covered)
    )
    return expected.join(found, key, "left").withColumn("coverage_status", status)
