"""Uniqueness of record IDs from the order of stored rows."""

import pytest
from pyspark.sql import functions as F

from coverlens import standin
from coverlens.plans import CheckFailed, build_export, checks, pv_rows, verify_export
from coverlens.sources.order import all_different, rising_ranges


def stored(spark, path, files):
    for i, values in enumerate(files):
        frame = spark.createDataFrame([(v,) for v in values], "n long").coalesce(1)
        frame.write.mode("append").parquet(f"{path}/part={i}")
    return spark.read.parquet(str(path))


@pytest.mark.parametrize(
    "files, different",
    [
        ([range(5000), range(5000, 9000)], True),
        ([range(100, 200), range(50), [10**15]], True),  # files in any order
        ([range(100), range(99, 150)], False),  # two files meet in a number
        ([[1, 2, 2, 3]], False),
        ([[2, 1]], False),
        ([[1, None, 3]], False),
        ([[*range(20_000), 19_999]], False),  # repeats over a batch's end
        ([[]], True),
    ],
)
def test_ranges_tell(spark, tmp_path, files, different):
    table = stored(spark, tmp_path / "t", files)
    assert all_different(table, "n") is different
    assert rising_ranges(table, "n").count() == sum(len(f) > 0 for f in files)


@pytest.fixture(scope="module")
def made(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("export") / "systems")
    release = standin.records(spark, sf_dir)
    return release, build_export(release, standin.EXPORT, path, rows_per_file=400)


def test_ids_are_proven_without_comparing_them(made, monkeypatch):
    release, export = made
    calls = []
    whole = checks.export_metrics
    monkeypatch.setattr(checks, "export_metrics", lambda e, unique_row=False: calls.append(unique_row) or whole(e, unique_row))
    got = verify_export(export.table, pv_rows(release), stored=True)
    assert got == export.metrics == verify_export(export.table, pv_rows(release))
    assert calls == [True, False]
    text = whole(export.table, True)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 0


def test_wrong_ids_in_an_ordered_file_are_caught(spark, made, tmp_path):
    release, export = made
    path = str(tmp_path / "bad")
    bad = F.when(F.col("tts_row") % 7 == 0, F.concat(F.lit("x"), (F.col("tts_row") % 5).cast("string")))
    export.table.withColumn("source_record_id", F.coalesce(bad, F.col("source_record_id"))).write.parquet(path)
    with pytest.raises(CheckFailed, match="record IDs"):
        verify_export(spark.read.parquet(path), pv_rows(release), stored=True)
