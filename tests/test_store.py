"""Reports from the shared store equal those from the records, which are read three times."""

import pytest
from pyspark.sql import functions as F

from coverlens import standin
from coverlens.plans import REPORTS, build_store, cells, report_from, run_report, write_reports
from coverlens.plans.store import SETS, cells_of


@pytest.fixture(scope="module")
def release(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("release") / "release.parquet")
    records = standin.records(spark, "/root/testdata/sf0.001")
    # what the stand-in never has: NULL keys, sizes and dates
    odd = records.limit(60).withColumns(
        {
            standin.ROW_ID: F.col(standin.ROW_ID) + 5 * 10**12,
            "state": F.when(F.col(standin.ROW_ID) % 2 == 0, F.col("state")),
            "zip_code": F.when(F.col(standin.ROW_ID) % 3 > 0, F.col("zip_code")),
            "data_provider_1": F.lit(None).cast("string"),
            "PV_system_size_DC": F.when(F.col(standin.ROW_ID) % 4 > 0, F.col("PV_system_size_DC")),
            "installation_date": F.when(F.col(standin.ROW_ID) % 5 > 0, F.col("installation_date")),
        }
    )
    records.unionByName(odd).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def store(release):
    return build_store(release, standin.STUDY)


@pytest.mark.parametrize("name", REPORTS)
def test_same_table_from_the_store(release, store, name):
    plain = run_report(name, release, standin.STUDY)
    found = report_from(store, name, standin.STUDY)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_one_set_is_the_same_alone(release, store):
    for name in SETS:
        alone = cells(release, standin.STUDY, name)
        assert sorted(map(str, alone.collect())) == sorted(map(str, cells_of(store.cells, name).collect()))


def test_cells_of_an_empty_table(release):
    empty = release.limit(0)
    assert cells(empty, standin.STUDY).count() == 0
    assert [tuple(r) for r in run_report("02_overview", empty, standin.STUDY).collect()] == [(0, 0, 0, None, None, 0)]
    assert run_report("06i_zip5_recovery", empty, standin.STUDY).first()["non_missing"] == 0
    for name in ("06_size_bands", "06h_zip_format_check", "23_midscale_penetration"):
        assert run_report(name, empty, standin.STUDY).count() == 0


def test_records_are_read_three_times(spark, release, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    short = {n: REPORTS[n] for n in ("01_schema", "02_overview", "06_size_bands", "06c_size_bands_by_state", "06g_dedup_window_sensitivity", "24_income_distribution")}
    monkeypatch.setattr("coverlens.plans.reports.REPORTS", short)
    rows = release.count()
    names = write_reports(release.mapInArrow(seen, release.schema), str(tmp_path / "out"), standin.STUDY)
    assert names == list(short) and read.value == 3 * rows


def test_cells_scan_once_and_combine_before_the_exchange(release):
    text = cells(release, standin.STUDY)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "partial_count" in text
    assert "SortAggregate" not in text
