"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as registry
from coverlens import standin
from coverlens.operators.projects import ProjectRule, first_of_project, window_sensitivity


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def release(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("release") / "release.parquet")
    standin.records(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.LLM_QUERIES])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert not re.search(r"Python|ArrowEval|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scan_is_pruned_and_filtered(release):
    text = plan(registry.REPORTS["04_state_coverage"](release, standin.STUDY))
    scan = re.search(r"FileScan parquet \[(.*?)\]", text)
    assert len(scan.group(1).split(",")) == 4
    pushed = text[text.index("PushedFilters") :]
    assert "IsNotNull(PV_system_size_DC), GreaterThanOrEqual(installation_date" in pushed


@pytest.mark.parametrize(
    "build",
    [
        lambda df: window_sensitivity(df, ProjectRule(), [0, 12]),
        lambda df: first_of_project(df, ProjectRule(), ["customer_segment"]),
    ],
)
def test_windows_run_on_combined_months_only(release, build):
    """Below every window over a link there is an aggregate by (link, month)."""
    text = plan(build(release))
    for window in re.finditer(r"Window \[", text):
        assert re.search(r"Aggregate\(keys?=\[", text[window.end() :])
        assert "partial_" in text[window.end() :]
