import random
import statistics

import pytest

from coverlens.operators import exact_median, ntile_expression, order_statistics
from pyspark.sql import functions as F


def sample(seed, size):
    rnd = random.Random(seed)
    hot = [("hot", 7.25)] * (size // 3)  # a third of all rows share one key and one value
    rest = [
        (rnd.choice(["hot", "a", "b", None]), rnd.choice([rnd.uniform(-50, 50), rnd.lognormvariate(3, 4), 0.0, 7.25, None]))
        for _ in range(size)
    ]
    return hot + rest + [("single", 1.5), ("empty", None)]


OPTIONS = [
    {},
    {"refine_rows": 3},  # always refine
    {"broadcast_rows": 0},  # never broadcast
    {"refine_rows": 3, "broadcast_rows": 0},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_grouped_median(spark, options):
    rows = sample(1, 3000)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: (r["median"], r["_n"]) for r in exact_median(frame, ["k"], "v", **options).collect()}
    expected = {}
    for key in {k for k, _ in rows}:
        known = [v for k, v in rows if k == key and v is not None]
        if known:
            expected[key] = (statistics.median(known), len(known))
    assert got.keys() == expected.keys()
    for key, (median, n) in expected.items():
        assert got[key][0] == pytest.approx(median, rel=1e-15) and got[key][1] == n


@pytest.mark.parametrize("options", OPTIONS)
def test_every_rank_of_a_table(spark, options):
    data = sorted(random.Random(2).choices(range(-40, 90), k=60))
    frame = spark.createDataFrame([(v,) for v in data], "v long")
    ranks = {str(i): F.lit(i) for i in range(-1, 62)}
    rows = order_statistics(frame, [], "v", ranks, **options).collect()
    assert {r["_rank"]: (r["_value"], r["_less"]) for r in rows} == {
        i: (v, sum(x < v for x in data)) for i, v in enumerate(data)
    }


def test_values_that_share_a_coarse_bucket(spark):
    data = [1e6 + i * 1e-6 for i in range(999)]
    frame = spark.createDataFrame([(v,) for v in data], "v double")
    assert exact_median(frame, [], "v", refine_rows=5).first()["median"] == data[499]


@pytest.mark.parametrize("size", [0, 1, 3, 4, 10, 257])
@pytest.mark.parametrize("buckets", [1, 4, 7])
def test_ntile(spark, size, buckets):
    rnd = random.Random(size)
    rows = [(i, rnd.choice([0.5, 0.5, 0.5, 1.0, 2.0, rnd.random()])) for i in range(size)]
    frame = spark.createDataFrame(rows, "id long, v double").repartition(4)
    bucket = ntile_expression(frame, "v", "id", buckets, refine_rows=4)
    got = {r["id"]: r["b"] for r in frame.select("id", bucket.alias("b")).collect()}
    quota, extra = divmod(size, buckets)
    sizes = [quota + (b < extra) for b in range(buckets)]
    numbers = [b + 1 for b, n in enumerate(sizes) for _ in range(n)]
    ordered = [i for i, v in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert got == dict(zip(ordered, numbers))


def test_nan_is_larger_than_any_number(spark):
    for values in ([1.0, 2.0, float("nan")], [float("nan"), float("nan"), 5.0], [float("inf"), 1.0, float("nan")]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        got = exact_median(frame, [], "v").first()["median"]
        assert repr(got) == repr(frame.agg(F.median("v")).first()[0])


def test_weights_count_rows(spark):
    frame = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3), (None, 4)], "v double, times long")
    assert exact_median(frame, [], "v", weight="times").first()["median"] == 1.0


def test_few_heavy_values_end_the_refinement(spark):
    frame = spark.range(4000).selectExpr("1 + (id % 2) * 1e-9 AS v")
    assert exact_median(frame, [], "v", refine_rows=10).first()["median"] == pytest.approx(1 + 5e-10, abs=1e-12)
