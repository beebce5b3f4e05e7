"""Centroid clustering against plain rounds over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from coverlens.llm import centroids as operator
from coverlens.llm.queries import ORACLES, QUERIES
from tests.comparing import differences, duck

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, dims, scale=256):
    kept = []
    for vec_id, vector in rows:
        fits = vec_id is not None and vector is not None and len(vector) == dims
        if fits and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for i, members in groups.items():
            middles[i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(vec_id, nearest(v)) for vec_id, v in kept]
    total = sum(d for _, (d, _) in found)
    own = {}
    for _, (d, i) in found:
        own[i] = own.get(i, 0) + d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted((vec_id, i, d, own[i], total, digest[i]) for vec_id, (d, i) in found)


def ours(spark, rows, **options):
    return sorted(tuple(r) for r in operator.cluster(spark.createDataFrame(rows, SCHEMA), **options).collect())


@pytest.mark.parametrize("spread, dims", [(0.5, 6), (0.02, 3), (4e5, 4)])
def test_against_all_pairs(spark, spread, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(dims)]) for i in range(400)]
    rows += [(rng.randrange(400), rows[0][1]) for _ in range(200)]  # a hot vector, some ids twice
    options = {"k": 9, "rounds": 4, "dims": dims}
    assert ours(spark, rows, block_rows=16, **options) == plain(rows, **options)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [math.nan] * 4), (103, [math.inf] * 4), (104, [1.0] * 3), (None, [0.1] * 4), (105, [])]
    options = {"k": 40, "rounds": 2, "dims": 4}
    assert ours(spark, rows + odd, **options) == plain(rows, **options)  # fewer vectors than centroids
    assert ours(spark, odd, **options) == [] == ours(spark, [], **options)


def test_clashing_columns_are_ignored(spark):
    rows = [(i, [float(i), 1.0]) for i in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS key", "2 AS `a.b`", "3 AS n")
    found = operator.cluster(frame, k=3, rounds=2, dims=2)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 3, 2, 2)


def test_a_component_beyond_the_range_is_named(spark):
    with pytest.raises(PySparkException, match="vector 7 has a component beyond"):
        ours(spark, [(6, [0.0, 1.0]), (7, [1e300, 1.0])], k=1, rounds=1, dims=2)


def test_hilbert_neighbours_are_one_step_apart():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in operator.hilbert_keys(cells, bits)]
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_of_clustered_vectors_rule_centroids_out():
    rng = np.random.default_rng(3)
    middles = rng.integers(-500, 500, (40, 16))
    kept = 0
    for middle in middles:
        points = middle + rng.integers(-20, 20, (64, 16))
        among = operator.candidates(points.min(0), points.max(0), middles)
        every, distance = operator.nearest(points, np.arange(40), middles)
        some, least = operator.nearest(points, among, middles)
        assert (every == some).all() and (distance == least).all()
        kept += len(among)
    assert kept < 80  # of 1,600


def test_exact_beyond_the_range_of_doubles():
    far = np.array([[1 << 26, 0], [(1 << 26) + 1, 0]], np.int32)
    cluster, distance = operator.nearest(far, np.array([0, 1]), np.array([[-(1 << 26), 1], [-(1 << 26), 0]], np.int64))
    assert cluster.tolist() == [1, 1] and distance.tolist() == [1 << 54, ((1 << 27) + 1) ** 2]


def test_query_equals_statement(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES["op12_centroids"](spark, sf_dir), duck(sf_dir), ORACLES["op12_centroids"]) == []
