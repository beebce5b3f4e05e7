"""CSV files with line breaks in quotes, cut by byte ranges, against Spark's one-task reader."""

import csv
import random

import pytest

from coverlens.sources import convert_csv, read_cut
from coverlens.sources.records import _lines, can_cut, cut_records

OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": True}


def text(rng):
    parts = ["plain", 'with "quotes"', "two\nlines", "three\n\n lines", "\r\n", "\r", ",", '"', "\n", "é ß", ""]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(4)))


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC)
        writer.writerow(["id", "note", "number", "more"])
        writer.writerows(rows)
    return str(path)


def some(seed, n, long=0):
    rng = random.Random(seed)
    rows = [(f"{i:05}", text(rng), rng.randrange(100), text(rng)) for i in range(n)]
    if long:
        rows[n // 2] = (f"{n // 2:05}", "line\n" * long, 7, 'x"y')
    return rows


@pytest.fixture
def short_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed, n, long, end", [(1, 300, 0, "\n"), (2, 300, 0, "\r\n"), (3, 60, 800, "\n"), (4, 1, 0, "\n"), (5, 0, 0, "\n")])
def test_equal_to_the_rows_and_to_the_one_task_reader(spark, tmp_path, short_ranges, seed, n, long, end):
    rows = some(seed, n, long)
    path = write(tmp_path / "rows.csv", rows, end)
    types = "id string, note string, number int, more string"
    whole = spark.read.options(**OPTIONS).schema(types).csv(path)
    cut = read_cut(spark, path, OPTIONS, whole.schema)
    assert cut.schema == whole.schema
    assert rows_of(cut) == sorted(((i, a or None, x, b or None) for i, a, x, b in rows), key=repr)
    if end == "\n":  # with the other line end that reader changes the line ends within texts too
        assert rows_of(cut) == rows_of(whole)
    if n > 1:
        assert _lines(spark, path).rdd.getNumPartitions() > 5
    inferred = {**OPTIONS, "inferSchema": True, "samplingRatio": 1.0}
    assert read_cut(spark, path, inferred).schema == spark.read.options(**inferred).csv(path).schema


def test_several_files_and_records_over_many_ranges(spark, tmp_path, short_ranges):
    (tmp_path / "in").mkdir()
    for i in range(3):
        write(tmp_path / "in" / f"{i}.csv", some(10 + i, 80, 500 * i))
    path = str(tmp_path / "in")
    whole = spark.read.options(**OPTIONS).csv(path)
    assert rows_of(read_cut(spark, path, OPTIONS, whole.schema)) == rows_of(whole)


def test_marks_are_characters_the_file_does_not_hold(spark, tmp_path):
    path = write(tmp_path / "marks.csv", [("1", "a\nb", 1, "")])
    _, marks = cut_records(spark, path)
    assert marks == ""
    full = write(tmp_path / "full.csv", [("1", "".join(chr(0xE000 + i) for i in range(8)), 1, "")])
    assert cut_records(spark, full) is None


def test_conversion_cuts_in_parallel(spark, tmp_path, short_ranges):
    rows = some(20, 200, 300)
    path = write(tmp_path / "release.csv", rows)
    target = str(tmp_path / "release.parquet")
    found = convert_csv(spark, path, target, ["id"], leading_zero_column="id", csv_options={"multiLine": True})
    assert found["rows"] == 200
    stored = {r["id"]: (r["note"] or "", r["number"], r["more"] or "") for r in spark.read.parquet(target).collect()}
    assert stored == {r[0]: r[1:] for r in rows}


def test_other_quoting_is_left_to_the_reader():
    assert can_cut(OPTIONS)
    assert not can_cut({**OPTIONS, "escape": "\\"}) and not can_cut({**OPTIONS, "comment": "#"}) and not can_cut({**OPTIONS, "header": False})
