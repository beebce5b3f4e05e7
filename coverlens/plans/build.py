"""The whole export in one call: write, read again, prove, sum up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from coverlens.plans.checks import verify_export
from coverlens.plans.export import loading_ratio_medians, pv_rows, write_export
from coverlens.plans.params import ExportParams
from coverlens.plans.summaries import band_summary, flag_summary, median_summary, method_counts
from coverlens.session import materialize


@dataclass(frozen=True)
class Export:
    """The written table, the numbers that were checked, and its four summaries."""

    table: DataFrame
    metrics: dict
    summaries: dict[str, DataFrame]


def build_export(
    df: DataFrame,
    p: ExportParams,
    path: str,
    *,
    first_year: int = 1996,
    expected_in_window: int | None = None,
    rows_per_file: int | None = None,
    overwrite: bool = False,
) -> Export:
    """Write the export, verify the re-read file (``CheckFailed`` if it is bad) and sum it up.

    The ratio medians are computed once, for the export and for their own summary.
    """
    pv = pv_rows(df)
    medians = materialize(loading_ratio_medians(pv, p))
    table = write_export(
        df, p, path, rows_per_file=rows_per_file, overwrite=overwrite, medians=medians
    )
    metrics = verify_export(table, pv, expected_in_window, stored=True)
    summaries = {
        "medians": median_summary(medians, p.min_median_rows, first_year),
        "methods": method_counts(table),
        "bands": band_summary(table),
        "flags": flag_summary(table),
    }
    return Export(table, metrics, summaries)
