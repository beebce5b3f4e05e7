"""Settings of a study; the defaults are the ones the published tables use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from coverlens import schema
from coverlens.operators.duplicates import DuplicateRule
from coverlens.operators.projects import ProjectRule


@dataclass(frozen=True)
class StudyParams:
    min_kw: float = 100
    max_kw: float = 2000
    start_date: str = "2018-01-01"
    project: ProjectRule = field(default_factory=ProjectRule)
    sensitivity_windows: Sequence[int] = (0, 1, 3, 12, 36, 999)
    any_gap_window: int = 999
    pivot_years: Sequence[int] = tuple(range(2018, 2026))
    early_years: tuple[int, int] = (2018, 2020)
    late_years: tuple[int, int] = (2022, 2024)
    min_installer_rows: int = 5
    min_cell_rows: int = 10
    min_state_rows: int = 25
    min_market_rows: int = 500
    top_installers: int = 30
    top_cells: int = 40
    top_utilities: int = 30
    reference_states: Sequence[str] = tuple(schema.STATE_CODES)
    thin_below: int = 25
    income_buckets: int = 4
    # unique column that settles ties; ``sources.load`` provides it
    row_id: str = "tts_row"


@dataclass(frozen=True)
class ExportParams:
    source_vintage: str
    start_date: str = "2018-01-01"
    plausible_ratio: tuple[float, float] = (0.8, 2.0)
    min_median_rows: int = 30
    project: ProjectRule = field(default_factory=ProjectRule)
    duplicate: DuplicateRule = field(default_factory=DuplicateRule)
    row_id: str = "tts_row"
