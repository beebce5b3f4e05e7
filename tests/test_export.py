import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from coverlens import schema, standin
from coverlens.plans import (
    REPORTS,
    CheckFailed,
    accounting,
    build_export,
    export_systems,
    pv_rows,
    verify_export,
    write_export,
    write_reports,
)


@pytest.fixture(scope="module")
def release(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("release") / "release.parquet")
    standin.records(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_write_export_is_ordered_and_verified(spark, release, tmp_path):
    numbered = release.withColumn("tts_row", F.col(standin.ROW_ID) % 1_000_000_000_000 * 2 + F.col(standin.ROW_ID).cast("string").startswith("1000").cast("int") + 1)
    params = dataclasses.replace(standin.EXPORT, row_id="tts_row")
    written = write_export(numbered, params, str(tmp_path / "systems"), rows_per_file=1000)
    assert tuple(written.columns) == schema.EXPORT_COLUMNS and len(written.columns) == 53
    rows = [r["tts_row"] for r in written.select("tts_row").collect()]
    assert len(set(rows)) == pv_rows(release).count()
    parts = sorted(os.path.join(tmp_path, "systems", f) for f in os.listdir(tmp_path / "systems") if f.startswith("part-"))
    in_order = [r[0] for p in parts for r in spark.read.parquet(p).select("tts_row").collect()]
    assert in_order == sorted(in_order) and len(parts) > 1
    got = verify_export(written, pv_rows(release))
    with pytest.warns(UserWarning, match="systems in the window"):
        verify_export(written, pv_rows(release), expected_in_window=got["n_window"] + 1)
    assert sorted(map(str, written.collect())) == sorted(map(str, export_systems(numbered, params).collect()))


@pytest.mark.parametrize(
    "damage, message",
    [
        (lambda e: e.filter("tts_row % 50 <> 3"), "PV rows read"),
        (lambda e: e.withColumn("source_record_id", F.lit("x")), "record IDs: 1 different"),
        (lambda e: e.withColumn("capacity_mw_dc", F.col("capacity_mw_dc") * 1.01), "DC megawatts"),
        (lambda e: e.withColumn("technology_type", F.lit("storage-only")), "storage without PV"),
        (lambda e: e.withColumn("capacity_mw_ac", F.lit(None).cast("double")), "AC size missing"),
    ],
)
def test_damage_is_caught(release, damage, message):
    columns = [
        "source_record_id", "tts_row", "capacity_mw_dc", "technology_type", "capacity_mw_ac",
        "in_window", "zip_code", "zip5", "price_per_w_dc",
    ]
    export = export_systems(release, standin.EXPORT, columns)
    with pytest.raises(CheckFailed, match=message):
        verify_export(damage(export), pv_rows(release))


def test_every_row_is_accounted_for(release):
    row = accounting(release).first()
    assert row["rows_in_release"] == row["pv_rows_kept"] + row["storage_only_dropped"] + row["no_size_dropped"]


def test_raw_columns_are_read_although_names_repeat(release):
    columns = ["zip_code", "zip5", "customer_segment", "likely_community_solar", "system_id_1", "source_vintage"]
    export = export_systems(release, standin.EXPORT, columns)
    assert export.filter("zip_code = '-1' OR customer_segment = '-1' OR system_id_1 = '-1'").count() == 0
    assert export.filter("zip_code = 'redacted' AND zip5 IS NULL").count() > 0
    assert export.filter("likely_community_solar").count() > 0


def test_every_report_is_written(spark, release, tmp_path):
    names = write_reports(release, str(tmp_path / "out"), standin.STUDY)
    assert names == list(REPORTS) and len(names) == 34
    for name in names:
        assert spark.read.option("header", True).csv(f"{tmp_path}/out/{name}").columns


def test_export_in_one_call(spark, release, tmp_path):
    made = build_export(release, standin.EXPORT, str(tmp_path / "whole"), first_year=1996)
    assert set(made.summaries) == {"medians", "methods", "bands", "flags"}
    assert made.metrics["n"] == made.table.count() == pv_rows(release).count()
    for summary in made.summaries.values():
        assert summary.count() > 0
    with pytest.raises(Exception, match="EXISTS"):
        build_export(release, standin.EXPORT, str(tmp_path / "whole"))
