"""Exact top-k against scoring every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from coverlens.llm import topk
from coverlens.llm.queries import ORACLES, QUERIES
from tests.comparing import differences, duck


def plain(rows, k, picked):
    def floored(vector):
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            return None
        return [math.floor(64 * float(x)) for x in vector]

    vectors = [(i, floored(v)) for i, v in rows if i is not None and floored(v) is not None]
    out = []
    for q, a in vectors:
        if picked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in vectors if c != q and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.6, 1e6, 5e6])
def test_against_every_pair(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    rng = random.Random(int(spread))
    rows = [(i - 20, [rng.uniform(-spread, spread) for _ in range(5)]) for i in range(150)]
    rows += [(200 + i, [0.25, 0.5, 0.0, -1.0, 0.125]) for i in range(60)]  # ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (305, [float("inf")] * 5)]
    rows += [(None, [0.5] * 5), (310, []), (320, [1.0, 2.0]), (321, [1.0, -2.0]), (400, [0.0] * 5)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, lane int, state string")
    found = topk.top_k(table.repartition(3), F.col("vec_id") % 10 == 0, 4)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 4, lambda i: i % 10 == 0)


def test_no_rows(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(table, F.col("vec_id") >= 0).collect() == []


def test_scores_beyond_a_long_are_refused(spark):
    table = spark.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(table, F.col("vec_id") == 0).collect()


def test_query_equals_statement(spark, sf_dir):
    assert differences(QUERIES["op3_topk"](spark, sf_dir), duck(sf_dir), ORACLES["op3_topk"]) == []


def test_blocks_meet_in_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_LANE", 2)
    monkeypatch.setattr(topk, "CANDIDATE_LANE", 3)
    seen = []
    monkeypatch.setattr(topk, "GROUPS_A_CORE", 0)
    monkeypatch.setattr(topk, "ship", lambda spark: seen.append(spark))
    rng = random.Random(3)
    rows = [(i, [rng.choice([-2.0, 0.5, 1.0, 300.0]) for _ in range(6)]) for i in range(240)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(table, F.col("vec_id") % 4 == 0, 6)
    # no row holds a pair of blocks, and no side goes to all tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert seen and "CoGroups" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 6, lambda i: i % 4 == 0)


def test_blocks_are_as_narrow_as_their_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "WIDTH", 4)
    rows = [(i, [float(i), -1.0, 0.0, 1.0] * 3) for i in range(30)]
    vectors = topk._vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1.0)
    blocks, packed = topk._blocks(vectors, 20, "blocks")
    made = blocks.collect()
    # 12 numbers a row, but blocks of 20 rows of 4: more of them, and with fewer rows
    assert packed == 5 and sum(b.n for b in made) == 30 and all(b.n * 12 <= 2 * 20 * 4 for b in made)
    assert {b.kind for b in made} == {"<i1"} and all(len(b.matrix) == 12 * b.n for b in made)
    assert [topk._kind(x) for x in (127.0, 128.0, 2.0**15, 2.0**31)] == ["<i1", "<i2", "<i4", "<f8"]
