"""Small tables over a finished export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.functions import round_to, share
from coverlens.operators.tables import totals


def median_summary(medians: DataFrame, min_rows: int, first_year: int) -> DataFrame:
    """Median ratio by build year over all segments, from ``export.loading_ratio_medians``."""
    yearly = medians.filter((F.col("_level") == 1) & (F.col("_n") >= min_rows))
    return (
        yearly.filter(F.col("_year") >= first_year)
        .select(
            F.col("_year").alias("build_year"),
            round_to(F.col("median"), 3).alias("median_ilr"),
            F.col("_n").alias("n"),
        )
        .orderBy("build_year")
    )


def method_counts(export: DataFrame) -> DataFrame:
    counts = export.groupBy("capacity_ac_method").agg(totals.rows().alias("systems"))
    return counts.orderBy(F.desc("systems"), "capacity_ac_method")


def band_summary(export: DataFrame) -> DataFrame:
    return (
        export.filter("in_window")
        .groupBy("size_band_dc")
        .agg(
            totals.rows().alias("systems"),
            round_to(F.sum("capacity_mw_dc"), 0).alias("mw_dc"),
            share(F.count("price_per_w_dc"), totals.rows()).alias("pct_priced"),
        )
        .orderBy("size_band_dc")
    )


def flag_summary(export: DataFrame) -> DataFrame:
    return export.filter("in_window").agg(
        F.count_if("likely_community_solar").alias("likely_community_solar"),
        F.count_if("exact_duplicate").alias("exact_duplicate"),
        F.count_if(~F.col("is_first_at_address")).alias("later_phase_at_address"),
        F.count_distinct("state").alias("states"),
    )
