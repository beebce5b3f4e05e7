import datetime as dt

import pytest
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions import (
    between_half_open,
    blank,
    decode,
    likely_community_solar,
    months_apart,
    round_to,
    share,
    size_band,
    size_band_strict,
    tri_state,
    zip5,
    zip_format,
)
from coverlens.functions.postal import is_zip5


def values(spark, rows, kind, *columns):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r) for r in frame.orderBy("i").select(*columns).collect()]


ZIPS = [
    ("94103", "94103", True, schema.ZIP_CLEAN),
    ("65014.0", "65014", True, schema.ZIP_FLOAT),
    ("1001", "01001", True, schema.ZIP_SHORT),
    ("05039-9602", "05039", True, schema.ZIP_PLUS4),
    ("1001-1234", "01001", True, schema.ZIP_OTHER),
    ("1001.0", "01001", True, schema.ZIP_FLOAT),
    ("-1", None, None, schema.ZIP_MISSING),
    ("redacted", None, None, schema.ZIP_MISSING),
    ("Clinton", "Clint", False, schema.ZIP_OTHER),
    ("\t", "0000\t", False, schema.ZIP_OTHER),
    ("0.0", "00000", True, schema.ZIP_FLOAT),
    ("6175551234", "61755", True, schema.ZIP_OTHER),
    ("617-555-1234", "00617", True, schema.ZIP_OTHER),
    ("", "00000", True, schema.ZIP_OTHER),
    ("94103\n", "94103", True, schema.ZIP_OTHER),
    (None, None, None, schema.ZIP_OTHER),
]


def test_zip_repair_and_shapes(spark):
    code = zip5(F.col("x"))
    got = values(spark, [z[0] for z in ZIPS], "string", code, is_zip5(code), zip_format(F.col("x")))
    assert got == [z[1:] for z in ZIPS]


@pytest.mark.parametrize(
    "kw, number, inside",
    [
        (4.999, 1, False), (5.0, 2, False), (10.0, 3, False), (20.0, 4, False), (50.0, 5, False),
        (99.999, 5, False), (100.0, 6, True), (250.0, 7, True), (500.0, 8, True), (1000.0, 9, True),
        (1999.999, 9, True), (2000.0, 10, False), (5000.0, 11, False), (-1.0, 1, False),
    ],
)
def test_ladder_edges(spark, kw, number, inside):
    got = values(
        spark, [kw], "double", size_band(F.col("x")), size_band_strict(F.col("x")),
        between_half_open(F.col("x"), 100, 2000),
    )
    assert got == [(schema.SIZE_LABELS[number - 1],) * 2 + (inside,)]


def test_ladder_null(spark):
    assert values(spark, [None], "double", size_band(F.col("x")), size_band_strict(F.col("x"))) == [
        (schema.SIZE_LABELS[-1], None)
    ]


def test_flags_and_sentinels(spark):
    label = decode(F.col("x"), schema.MOUNT_LABELS, schema.MOUNT_UNKNOWN)
    got = values(spark, [1, 0, -1, None], "int", tri_state(F.col("x")), blank(F.col("x"), -1), label)
    assert got == [
        (True, 1, "ground-mount"), (False, 0, "rooftop"), (None, None, "unknown"), (None, None, "unknown"),
    ]
    text = values(spark, ["-1", "redacted", "x"], "string", blank(F.col("x"), "-1"), blank(F.col("x"), "-1", "redacted"))
    assert text == [(None, None), ("redacted", None), ("x", "x")]


def test_community_solar_threshold(spark):
    solar = likely_community_solar(F.lit("RES"), F.col("x"))
    assert values(spark, [499.9, 500.0], "double", solar) == [(False,), (True,)]


def test_rounding_scales_in_binary(spark):
    got = values(spark, [1.005, 0.285, 2.5, -2.5], "double", round_to(F.col("x"), 2), round_to(F.col("x"), 0))
    assert got == [(1.0, 1.0), (0.28, 0.0), (2.5, 3.0), (-2.5, -3.0)]
    assert values(spark, [3], "int", share(F.col("x"), F.lit(7)), share(F.col("x"), F.lit(0))) == [(42.9, None)]


def test_months_count_boundaries(spark):
    first = F.lit(dt.date(2019, 1, 31))
    days = [dt.date(2019, 1, 31), dt.date(2019, 2, 1), dt.date(2019, 12, 1), dt.date(2020, 1, 1), dt.date(2020, 12, 31)]
    assert values(spark, days, "date", months_apart(first, F.col("x"))) == [(0,), (1,), (11,), (12,), (23,)]
