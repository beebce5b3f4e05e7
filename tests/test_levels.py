"""Order statistics of several levels at once, and how often the rows are read."""

import random
import statistics

import pytest

from coverlens.operators import exact_median, fallback_medians

OPTIONS = [{}, {"refine_rows": 3}, {"broadcast_rows": 0}, {"refine_rows": 3, "broadcast_rows": 0}]
SCHEMA = "a string, b int, v double, w long"


def sample(seed, size=1500):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.uniform(0.5, 2.5), 1.25, 1.25, rng.lognormvariate(0, 2), -3.0, None])
    rows = [("hot", 1, 1.25, 1)] * (size // 3)  # a third of all rows share one key and one value
    return rows + [(rng.choice(["hot", "x", "y", None]), rng.choice([1, 2, 3, None]), value(), rng.randrange(1, 4)) for _ in range(size)]


def plain(rows, levels, weighted):
    groups = {}
    for a, b, v, w in rows:
        if v is not None:
            for level in levels:
                key = (level, a if level > 0 else None, b if level > 1 else None)
                groups.setdefault(key, []).extend([v] * (w if weighted else 1))
    return {key: (statistics.median(values), len(values)) for key, values in groups.items()}


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("levels, weighted", [((0, 1, 2), False), ((2, 0), True), ((1,), False)])
def test_every_level_equals_sorting(spark, options, levels, weighted):
    rows = sample(len(levels))
    found = exact_median(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "v", levels=levels, weight="w" if weighted else None, **options)
    assert found.columns == ["_level", "a", "b", "median", "_n"]
    got = {(r["_level"], r["a"], r["b"]): (r["median"], r["_n"]) for r in found.collect()}
    want = plain(rows, levels, weighted)
    assert got.keys() == want.keys()
    for key, (median, n) in want.items():
        assert got[key][1] == n and abs(got[key][0] - median) < 1e-12


def test_no_values_give_no_groups(spark):
    frame = spark.createDataFrame([("x", 1, None, 1)], SCHEMA)
    assert exact_median(frame, ["a", "b"], "v", levels=(0, 1, 2)).count() == 0


@pytest.fixture
def counted(spark):
    """A table, and how many of its rows have been read."""
    read = spark.sparkContext.accumulator(0)
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y"]), rng.choice([1, 2, 3]), rng.uniform(0.9, 1.9), 1) for _ in range(6000)]

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, SCHEMA).mapInArrow(seen, SCHEMA), read, len(rows)


def test_all_levels_read_the_rows_twice(counted):
    frame, read, n = counted
    assert fallback_medians(frame, "v", ["a", "b"], (0.8, 2.0)).count() == 9
    assert read.value == 2 * n


@pytest.mark.parametrize("options", OPTIONS)
def test_refinement_does_not_read_the_rows_again(counted, options):
    frame, read, n = counted
    exact_median(frame, ["a"], "v", **options).collect()
    assert read.value == 2 * n


@pytest.mark.parametrize("options", OPTIONS)
def test_refined_levels_read_the_rows_twice(counted, options):
    frame, read, n = counted
    exact_median(frame, ["a", "b"], "v", levels=(0, 1, 2), **options).collect()
    assert read.value == 2 * n
