"""Ready-made plans: the reports, the cleaned export and its checks."""

from coverlens.plans.build import Export, build_export
from coverlens.plans.checks import CheckFailed, accounting, export_metrics, verify_export
from coverlens.plans.export import export_systems, pv_rows, write_export
from coverlens.plans.params import ExportParams, StudyParams
from coverlens.plans.reports import REPORTS, report_from, run_report, write_reports
from coverlens.plans.store import StudyStore, build_store, cells
from coverlens.plans.summaries import band_summary, flag_summary, median_summary, method_counts

__all__ = [
    "CheckFailed",
    "Export",
    "ExportParams",
    "REPORTS",
    "StudyStore",
    "StudyParams",
    "accounting",
    "band_summary",
    "build_export",
    "build_store",
    "cells",
    "export_metrics",
    "export_systems",
    "flag_summary",
    "median_summary",
    "method_counts",
    "pv_rows",
    "report_from",
    "run_report",
    "verify_export",
    "write_export",
    "write_reports",
]
