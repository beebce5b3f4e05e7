import glob

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from coverlens.sources import (
    ConversionFailed,
    convert_csv,
    describe,
    ensure_parquet,
    load,
    pinned_schema,
    with_row_position,
    write_csv_report,
    write_ordered,
    write_parquet,
)

TEXT = """zip_code,id,kw,flag,installed,note
02138,007,5.5,1,2018-01-02 00:00:00,"a ""quoted"", field"
94103,12,-1,-1,2019-03-04 00:00:00,plain
"""
PINS = ["zip_code", "id"]


@pytest.fixture
def release(tmp_path):
    path = tmp_path / "release.csv"
    path.write_text(TEXT)
    return str(path)


def test_pins_keep_text_and_the_rest_is_inferred(spark, release):
    kinds = {f.name: f.dataType.simpleString() for f in pinned_schema(spark, release, PINS)}
    assert kinds == {
        "zip_code": "string", "id": "string", "kw": "double", "flag": "int",
        "installed": "timestamp_ntz", "note": "string",
    }


def test_conversion_is_lossless(spark, release, tmp_path):
    target = str(tmp_path / "release.parquet")
    assert convert_csv(spark, release, target, PINS) == {"rows": 2, "columns": 6, "leading_zeros": 1}
    rows = [tuple(r)[:4] for r in with_row_position(spark, target).orderBy("tts_row").collect()]
    assert rows == [("02138", "007", 5.5, 1), ("94103", "12", -1.0, -1)]
    part = glob.glob(f"{target}/part-*.parquet")[0]
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
    with pytest.raises(FileExistsError):
        convert_csv(spark, release, target, PINS)
    convert_csv(spark, release, target, PINS, overwrite=True)


def test_identifier_typed_as_number_is_refused(spark, release, tmp_path):
    types = pinned_schema(spark, release, [])
    with pytest.raises(ConversionFailed, match="identifiers"):
        convert_csv(spark, release, str(tmp_path / "bad.parquet"), PINS, types=types)


def test_missing_pin_is_refused(spark, release):
    with pytest.raises(ConversionFailed, match="not in the file"):
        pinned_schema(spark, release, ["nope"])


def test_lost_leading_zeros_warn(spark, tmp_path):
    path = tmp_path / "no_zeros.csv"
    path.write_text("zip_code,id\n2138,1\n")
    with pytest.warns(UserWarning, match="starts with 0"):
        convert_csv(spark, str(path), str(tmp_path / "no_zeros.parquet"), PINS)


def test_broken_line_fails_instead_of_shifting_values(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text("zip_code,id,kw\n02138,1,5.5\n02139,2,not a number\n")
    types = pinned_schema(spark, str(path), PINS)
    types["kw"].dataType = type(pinned_schema(spark, str(path), [])["id"].dataType)()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|TASK_WRITE_FAILED"):
        convert_csv(spark, str(path), str(tmp_path / "broken.parquet"), PINS, types=types)


def test_build_only_when_missing(spark, release, tmp_path):
    target = str(tmp_path / "once.parquet")
    assert ensure_parquet(spark, release, target, PINS) is True
    assert ensure_parquet(spark, release, target, PINS) is False
    (tmp_path / "half.parquet" / "_temporary").mkdir(parents=True)
    assert ensure_parquet(spark, release, str(tmp_path / "half.parquet"), PINS) is True
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ensure_parquet(spark, str(tmp_path / "none.csv"), str(tmp_path / "x.parquet"), PINS)


def test_row_groups_are_bounded(spark, tmp_path):
    write_parquet(spark.range(0, 300_000, 1, 1), str(tmp_path / "groups"))
    meta = pq.ParquetFile(glob.glob(str(tmp_path / "groups/part-*"))[0]).metadata
    assert meta.num_row_groups >= 3
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 122_880


def test_positions_run_on_across_files_and_survive_filters(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    rows = with_row_position(spark, path)
    by_file = [pq.read_table(f).column("id").to_pylist() for f in sorted(glob.glob(f"{path}/part-*"))]
    flat = [i for ids in by_file for i in ids]
    assert {r["tts_row"]: r["id"] for r in rows.collect()} == {n + 1: i for n, i in enumerate(flat)}
    some = rows.filter("id % 97 = 5").collect()
    assert {r["id"]: r["tts_row"] for r in some} == {i: flat.index(i) + 1 for i in flat if i % 97 == 5}


def test_ordered_write(spark, tmp_path):
    path = str(tmp_path / "ordered")
    shuffled = spark.range(1, 1001).withColumnRenamed("id", "pos").repartition(9)
    write_ordered(shuffled, path, "pos", 1000, rows_per_file=300)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert [n for f in files for n in pq.read_table(f).column("pos").to_pylist()] == list(range(1, 1001))
    assert len(files) == 4


def test_report_csv_and_guard(spark, tmp_path):
    path = str(tmp_path / "report")
    write_csv_report(spark.range(3), path)
    files = glob.glob(f"{path}/part-*.csv")
    assert len(files) == 1 and open(files[0]).read() == "id\n0\n1\n2\n"
    with pytest.raises(AnalysisException):
        write_csv_report(spark.range(3), path)


def test_view_and_schema_listing(spark, tmp_path):
    path = str(tmp_path / "view")
    spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b").write.parquet(path)
    load(spark, path, view="opened")
    assert spark.sql("SELECT a, tts_row FROM opened").first() == (1, 1)
    assert [tuple(r) for r in describe(load(spark, path, position=None)).collect()] == [(1, "a", "int", 1), (2, "b", "string", 0)]


def test_unproven_stores_are_not_accepted(spark, release, tmp_path):
    target = str(tmp_path / "release.parquet")
    write_parquet(spark.range(10).selectExpr("id AS zip_code"), target)
    (tmp_path / "release.parquet" / "_SUCCESS").unlink()
    assert ensure_parquet(spark, release, target, PINS) is True  # a partial store is replaced
    assert spark.read.parquet(target).count() == 2
    bad, types = str(tmp_path / "bad.parquet"), pinned_schema(spark, release, [])
    for _ in range(2):  # a store that fails its checks does not appear, however often it is tried
        with pytest.raises(ConversionFailed):
            ensure_parquet(spark, release, bad, PINS, types=types)


def test_line_breaks_in_quotes_and_files_without_postal_codes(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('id,note\n007,"two\nlines"\n12,one\n')
    target = str(tmp_path / "lines.parquet")
    options = {"csv_options": {"multiLine": True}, "leading_zero_column": "id"}
    assert ensure_parquet(spark, str(path), target, ["id"], **options) is True
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [("007", "two\nlines"), ("12", "one")]
    assert ensure_parquet(spark, str(path), target, ["id"], **options) is False
