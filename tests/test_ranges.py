"""Ranges of equally many rows, and files cut by them."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coverlens import standin
from coverlens.operators import equal_cuts, range_number
from coverlens.plans import build_export, pv_rows
from coverlens.sources import write_ordered

NUMBERINGS = {
    "dense": list(range(1, 5001)),
    "gaps": [7 * i * i for i in range(3000)],
    "two far groups": [*range(1000), *(10**12 + 3 * i for i in range(1500))],
    "negative": [*range(-(10**15), -(10**15) + 700), *range(900)],
    "beyond doubles": [2**53 + i for i in range(1200)] + [0],
    "one": [42],
}


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "pos long").repartition(5)


@pytest.mark.parametrize("name", NUMBERINGS)
@pytest.mark.parametrize("every, buckets", [(300, 65_536), (77, 16), (10**6, 65_536)])
def test_cuts_are_at_every_nth_row(spark, name, every, buckets):
    values = sorted(NUMBERINGS[name])
    frame = numbers(spark, values)
    cuts = equal_cuts(frame, "pos", every, buckets=buckets)
    assert cuts == values[every::every]
    found = frame.select("pos", range_number(F.col("pos"), cuts).alias("n")).collect()
    assert {r["pos"]: r["n"] for r in found} == {v: i // every for i, v in enumerate(values)}


def test_repeated_missing_and_no_numbers(spark):
    rng = random.Random(1)
    values = [5] * 40 + [rng.randrange(60) for _ in range(200)]
    cuts = equal_cuts(numbers(spark, [*values, None, None]), "pos", 25)
    ordered = sorted(values)
    assert cuts == sorted({ordered[i] for i in range(25, len(ordered), 25)})
    assert equal_cuts(numbers(spark, [None]), "pos", 5) == [] == equal_cuts(numbers(spark, []), "pos", 5)
    assert spark.range(1).select(range_number(F.lit(None).cast("long"), [1, 2])).first()[0] == 0


@pytest.mark.parametrize("extent", [(1, 1000), (400, 600), (1, 10)])
def test_a_wrong_extent_costs_a_pass_only(spark, extent):
    assert equal_cuts(numbers(spark, range(1, 1001)), "pos", 300, extent=extent) == [301, 601, 901]


@pytest.mark.parametrize("name", ["gaps", "two far groups", "beyond doubles"])
def test_files_hold_equally_many_rows_in_order(spark, tmp_path, name):
    values = sorted(NUMBERINGS[name])
    path = str(tmp_path / "ordered")
    write_ordered(numbers(spark, random.Random(2).sample(values, len(values))), path, "pos", rows_per_file=400)
    files = [pq.read_table(f).column("pos").to_pylist() for f in sorted(glob.glob(f"{path}/part-*"))]
    assert files == [values[i : i + 400] for i in range(0, len(values), 400)]


def test_rows_are_read_once_and_counted_elsewhere(spark, tmp_path):
    """The table that is written runs once; its boundaries come from the narrow one."""
    spark.range(0, 2000, 1, 4).write.parquet(str(tmp_path / "narrow"))
    narrow = spark.read.parquet(str(tmp_path / "narrow"))
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    write_ordered(narrow.mapInArrow(seen, "id long"), str(tmp_path / "out"), "id", rows_per_file=600, counted=narrow)
    assert runs.value == 2000 and len(glob.glob(str(tmp_path / "out/part-*"))) == 4


def test_export_of_sparse_row_ids(spark, sf_dir, tmp_path):
    release = standin.records(spark, sf_dir)
    made = build_export(release, standin.EXPORT, str(tmp_path / "whole"), rows_per_file=400)
    ids = sorted(r[0] for r in pv_rows(release).select(standin.ROW_ID).collect())
    assert ids[-1] > 10**12
    files = [pq.read_table(f).column("tts_row").to_pylist() for f in sorted(glob.glob(str(tmp_path / "whole/part-*")))]
    assert files == [ids[i : i + 400] for i in range(0, len(ids), 400)]
    assert made.metrics["n"] == len(ids)
