"""A conversion is proven while it is written, and published whole."""

import os

import pytest
from pyspark.sql import functions as F

from coverlens.sources import ConversionFailed, convert_csv, ingest, store

PINS = ["zip_code", "id"]
TEXT = "zip_code,id,kw,note,more\n" + "".join(f"0{2100 + i},{i:03},{i / 4},{'x' * (i % 3)},{'' if i % 3 else 'y'}\n" for i in range(50))


@pytest.fixture
def release(tmp_path):
    path = tmp_path / "release.csv"
    path.write_text(TEXT)
    return str(path)


DAMAGE = {
    "values differ": lambda d: d.withColumn("kw", F.when(F.col("id") == "017", 99.0).otherwise(F.col("kw"))),
    "numbers of values differ in .'note'": lambda d: d.withColumn("note", F.when(F.col("id") != "004", F.col("note"))),
    "row counts differ: 50 -> 49": lambda d: d.filter("id <> '030'"),
    # the same values per column, but dealt to other rows
    "differ": lambda d: d.withColumn("id", F.when(F.col("id") == "001", "002").when(F.col("id") == "002", "001").otherwise(F.col("id"))),
}


@pytest.mark.parametrize("message", DAMAGE)
def test_a_changed_cell_is_caught(spark, release, tmp_path, monkeypatch, message):
    write = ingest.write_parquet
    monkeypatch.setattr(ingest, "write_parquet", lambda rows, path, **k: write(DAMAGE[message](rows), path, **k))
    target = str(tmp_path / "out")
    with pytest.raises(ConversionFailed, match=message):
        convert_csv(spark, release, target, PINS)
    assert not os.path.exists(target)


def test_the_csv_is_not_read_after_the_write(spark, release, tmp_path, monkeypatch):
    write = ingest.write_parquet

    def then_gone(rows, path, **options):
        write(rows, path, **options)
        os.unlink(release)

    monkeypatch.setattr(ingest, "write_parquet", then_gone)
    assert convert_csv(spark, release, str(tmp_path / "out"), PINS)["rows"] == 50


def test_the_old_store_stays_until_the_new_one_is_there(spark, release, tmp_path):
    target = str(tmp_path / "out")
    convert_csv(spark, release, target, PINS)
    with pytest.raises(FileNotFoundError):
        store.move(spark, str(tmp_path / "none"), target)
    assert spark.read.parquet(target).count() == 50
    convert_csv(spark, release, target, PINS, overwrite=True)
    assert spark.read.parquet(target).count() == 50
    assert sorted(os.listdir(tmp_path)) == ["out", "release.csv"]
