"""Distributed operators: ``DataFrame -> DataFrame``."""

from coverlens.operators.duplicates import DuplicateRule, copies_lookup, flag_exact_duplicates
from coverlens.operators.impute import fallback_medians, impute_from_medians, median_lookups
from coverlens.operators.keys import same_key
from coverlens.operators.lookup import Lookup, lookup_join, lookup_joins
from coverlens.operators.projects import (
    ProjectRule,
    first_of_project,
    flag_projects,
    project_lookup,
    window_sensitivity,
)
from coverlens.operators.ranges import equal_cuts, range_number
from coverlens.operators.selection import exact_median, ntile_expression, order_statistics
from coverlens.operators.tables import (
    band_distribution,
    coverage,
    cross_tab,
    gap_report,
    growth,
    measures,
    totals,
    with_median,
)

__all__ = [
    "DuplicateRule",
    "Lookup",
    "ProjectRule",
    "band_distribution",
    "copies_lookup",
    "coverage",
    "cross_tab",
    "equal_cuts",
    "exact_median",
    "fallback_medians",
    "first_of_project",
    "flag_exact_duplicates",
    "flag_projects",
    "gap_report",
    "growth",
    "impute_from_medians",
    "lookup_join",
    "lookup_joins",
    "measures",
    "median_lookups",
    "ntile_expression",
    "order_statistics",
    "project_lookup",
    "range_number",
    "same_key",
    "totals",
    "window_sensitivity",
    "with_median",
]
