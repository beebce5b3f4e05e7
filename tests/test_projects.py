import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from coverlens.operators import (
    DuplicateRule,
    ProjectRule,
    first_of_project,
    flag_exact_duplicates,
    flag_projects,
    lookup_join,
    window_sensitivity,
)

SCHEMA = (
    "id long, TTS_link_ID string, installation_date timestamp_ntz, PV_system_size_DC double, "
    "data_provider_1 string, system_ID_1 string, total_installed_price double"
)
RULE = ProjectRule()
CODES = ("-1", "redacted")


def records(seed, size=600):
    rnd = random.Random(seed)
    links = ["hot"] * 8 + [*"abcdefgh", *CODES, None, "-1", "-1"]
    return [
        (
            i,
            rnd.choice(links),
            rnd.choice([None] + [dt.datetime(2018, 1, 31) + dt.timedelta(days=rnd.randrange(2500)) for _ in range(9)]),
            rnd.choice([5.0, 5.0, 10.0, None]),
            rnd.choice(["p", "q", None]),
            rnd.choice(["1", "2", None]),
            rnd.choice([-1.0, 0.0, 100.0, 100.0, 250.5, None]),
        )
        for i in range(size)
    ]


def nulls_last(value):
    return (value is None, value if value is not None else "")


def brute_flags(rows, months, null_is_missing=False):
    """Row by row, straight from the definition."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = {}
    for link, members in groups.items():
        dates = [r[2] for r in members if r[2] is not None]
        first = min(dates) if dates else None
        best = {}
        for r in members:
            if r[2] is not None and months > 0:
                gap = (r[2].year * 12 + r[2].month) - (first.year * 12 + first.month)
                order = (r[2], nulls_last(r[3]), nulls_last(r[4]), nulls_last(r[5]), r[0])
                slot = gap // months
                best[slot] = min(best.get(slot, (order, r[0])), (order, r[0]))
        heads = {i for _, i in best.values()}
        alone = link in CODES or (link is None and null_is_missing) or months <= 0
        for r in members:
            out[r[0]] = (first, alone or r[2] is None or r[0] in heads)
    return out


@pytest.mark.parametrize("months", [0, 1, 3, 12, 36, 999])
@pytest.mark.parametrize("broadcast_rows", [1000, 2, 0])
def test_flags_match_definition(spark, months, broadcast_rows):
    rows = records(months)
    rule = dataclasses.replace(RULE, window_months=months)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = flag_projects(frame, rule, "id", broadcast_rows=broadcast_rows).collect()
    assert {r["id"]: (r["first_at_address"], r["is_first_at_address"]) for r in got} == brute_flags(rows, months)


def test_null_links_can_count_as_missing(spark):
    rows = records(5)
    rule = dataclasses.replace(RULE, null_is_missing=True)
    got = flag_projects(spark.createDataFrame(rows, SCHEMA), rule, "id").collect()
    expected = brute_flags(rows, 12, null_is_missing=True)
    assert {r["id"]: (r["first_at_address"], r["is_first_at_address"]) for r in got} == expected


def test_window_is_anchored_at_the_first_date(spark):
    days = [(2019, 1, 31), (2019, 12, 1), (2020, 1, 1), (2020, 12, 31)]
    rows = [(i, "A", dt.datetime(*d), 5.0, "p", "1", 1.0) for i, d in enumerate(days)]
    rows += [(10, "-1", dt.datetime(2019, 5, 1), 5.0, "p", "1", 1.0), (11, "-1", dt.datetime(2019, 6, 1), 5.0, "p", "1", 1.0)]
    got = flag_projects(spark.createDataFrame(rows, SCHEMA), RULE, "id").orderBy("id").collect()
    assert [r["is_first_at_address"] for r in got] == [True, False, True, False, True, True]


def test_tie_goes_to_smaller_id(spark):
    day = dt.datetime(2019, 1, 1)
    rows = [(0, "A", day, 5.0, "p", "2", 1.0), (1, "A", day, 5.0, "p", "1", 1.0)]
    heads = first_of_project(spark.createDataFrame(rows, SCHEMA), RULE, ["system_ID_1"]).collect()
    assert [r[0] for r in heads] == ["1"]


def test_sensitivity_matches_flags_and_nests(spark):
    rows = records(9, 900)
    windows = [0, 1, 3, 12, 36, 999]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["_window"]: r["projects"] for r in window_sensitivity(frame, RULE, windows).collect()}
    assert got == {n: sum(flag for _, flag in brute_flags(rows, n).values()) for n in windows}
    assert got[0] == len(rows) >= got[1] >= got[3] >= got[12] >= got[36]


@pytest.mark.parametrize("broadcast_rows", [1000, 1, 0])
def test_exact_duplicates(spark, broadcast_rows):
    rows = records(3, 800)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = flag_exact_duplicates(frame, DuplicateRule(), broadcast_rows=broadcast_rows)
    counts = {}
    for r in rows:
        counts[(r[1], r[3], r[6])] = counts.get((r[1], r[3], r[6]), 0) + 1
    expected = {
        r[0]: not (r[1] in CODES or (r[6] is not None and r[6] <= 0)) and counts[(r[1], r[3], r[6])] > 1 for r in rows
    }
    assert {r["id"]: r["exact_duplicate"] for r in got.collect()} == expected


@pytest.mark.parametrize("broadcast_rows", [100, 3, 0])
def test_lookup_join_keeps_rows_and_resolves_both_sides(spark, broadcast_rows):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 11 == 0 else f"k{i % 7}")) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, k string")
    table = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    table = table.filter("k is null or k <> 'k5'").withColumn("maybe", F.when(F.col("k") == "hot", "x"))
    got = lookup_join(frame, table, ["k"], weight="n", hit="found", broadcast_rows=broadcast_rows)
    last = {}
    for i, k in rows:
        last[k] = i
    expected = {(i, k, None if k == "k5" else last[k], "x" if k == "hot" else None, k != "k5") for i, k in rows}
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(rows)


def test_rows_of_a_heavy_key_stay_where_they_are(spark):
    """With two broadcast slots the hot key is answered by broadcast and never shuffled."""
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, k string").repartition(4)
    table = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(frame, table, ["k"], weight="n", broadcast_rows=2)
        sizes = joined.groupBy(F.spark_partition_id().alias("p"), "k").count().filter("k = 'hot'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2 * 2000 / 4


@pytest.mark.parametrize("broadcast_rows", [0, 2, 1000])
def test_rows_that_are_not_eligible_never_match(spark, broadcast_rows):
    rows = [(1, "a", True), (2, "a", False), (3, "b", True), (4, "c", None), (5, "hot", False), (6, "hot", True)]
    frame = spark.createDataFrame(rows, "id long, k string, able boolean")
    table = spark.createDataFrame([("a", 2, 10), ("b", 1, 20), ("c", 1, 30), ("hot", 900, 40)], "k string, n long, v long")
    got = lookup_join(frame, table, ["k"], weight="n", hit="found", eligible=F.col("able"), broadcast_rows=broadcast_rows)
    values = {"a": 10, "b": 20, "c": 30, "hot": 40}
    assert {(r.id, r.v, r.found) for r in got.collect()} == {(i, values[k] if able else None, bool(able)) for i, k, able in rows}


def test_wide_entries_count_as_many(spark):
    """Entries whose arrays exceed the limit are not broadcast, though they are few."""
    frame = spark.createDataFrame([(i, f"k{i % 5}") for i in range(100)], "id long, k string")
    table = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.collect_list("id").alias("ids"))
    got = lookup_join(frame, table, ["k"], weight="n", broadcast_rows=10)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.id in r.ids for r in got.collect()) and got.count() == 100


def test_undated_rows_of_a_large_link_are_not_shuffled(spark):
    dated = [(0, "hot", dt.datetime(2020, 1, 1))] + [(5000 + i, f"k{i}", dt.datetime(2020, 1, 1)) for i in range(40)]
    rows = [(i, link, date, 1.0, "p", "s", 1.0) for i, link, date in dated]
    rows += [(i, "hot", None, 1.0, "p", "s", 1.0) for i in range(1, 3001)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = flag_projects(frame, RULE, "id", broadcast_rows=10)
        parts = flagged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert flagged.count() == len(rows) and parts < 1000
        assert flagged.filter("NOT is_first_at_address").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
