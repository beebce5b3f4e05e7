"""Several lookups at once: one answer at every size, one exchange of the rows."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coverlens import schema, standin
from coverlens.operators import Lookup, equal_cuts, lookup_joins
from coverlens.plans import export_systems, pv_rows, write_export
from coverlens.plans.export import _attached


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    hot = lambda many: "hot" if rng.random() < 0.4 else rng.choice(many)
    names = [f"n{i}" for i in range(40)] + [None]
    rows = [(10**12 * (i % 2) + i, hot(names), rng.choice([1, 2, None, 3]), rng.random() < 0.8, f"x{i}") for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, name string, size int, may boolean, wide string").repartition(6)
    by_name = spark.createDataFrame([(n, i + 1 if n != "hot" else 400, f"v{n}", [i, i]) for i, n in enumerate([*names[:30], None, "hot"])], "name string, w long, about string, list array<long>")
    pairs = sorted({(r[1], r[2]) for r in rows if r[1] != "n3"}, key=str)
    by_both = spark.createDataFrame([(n, s, 1, None if s == 2 else i) for i, (n, s) in enumerate(pairs)], "name string, size int, w2 long, value long")
    by_size = spark.createDataFrame([(1, 300, "one"), (2, 300, "two")], "size int, w3 long, word string")
    return frame, by_name, by_both, by_size


def lookups(frames):
    _, by_name, by_both, by_size = frames
    return [
        Lookup(by_name, ["name"], "w", hit="named"),
        Lookup(by_both, ["name", "size"], "w2", hit="both", eligible=F.col("may")),
        Lookup(by_size, ["size"], "w3"),
    ]


def expected(frames):
    rows, by_name, by_both, by_size = ([tuple(r) for r in f.collect()] for f in frames)
    names = {r[0]: r[2:] for r in by_name}
    both = {r[:2]: r[3] for r in by_both}
    sizes = {r[0]: r[2] for r in by_size}
    out = []
    for i, name, size, may, wide in rows:
        about, items = names.get(name, (None, None))
        hit = may and (name, size) in both
        out.append((i, name, size, may, wide, about, items, name in names, both[name, size] if hit else None, hit, sizes.get(size)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 7, 30, 250_000])
@pytest.mark.parametrize("ordered", [False, True])
def test_one_answer_at_every_size(frames, broadcast_rows, ordered):
    cuts = equal_cuts(frames[0], "id", 200) if ordered else None
    found = lookup_joins(frames[0], lookups(frames), "id", cuts=cuts, broadcast_rows=broadcast_rows)
    assert found.columns == ["id", "name", "size", "may", "wide", "about", "list", "named", "value", "both", "word"]
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=str) == expected(frames)
    if ordered:
        assert [r[0] for r in rows] == sorted(r[0] for r in rows)
        assert found.rdd.getNumPartitions() == len(cuts) + 1


def wide_exchanges(frame, column):
    """Exchanges whose rows carry `column`, and scans that read it."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    lines = text.split("\n")
    exchanges = 0
    for n, line in enumerate(lines):
        if re.search(r"\+- Exchange|:- Exchange", line):
            below = re.sub(r"^[\s:+-]*", "", lines[n + 1])
            exchanges += column in " ".join(lines[n : n + 2]) or column in below
    return exchanges, len([line for line in lines if "FileScan" in line and f"{column}#" in line])


@pytest.mark.parametrize("ordered", [False, True])
def test_rows_move_once_with_every_table_large(spark, frames, tmp_path, ordered):
    path = str(tmp_path / "rows")
    frames[0].write.parquet(path)
    stored = spark.read.parquet(path)
    cuts = equal_cuts(stored, "id", 200) if ordered else None
    found = lookup_joins(stored, lookups(frames), "id", cuts=cuts, broadcast_rows=0)
    assert wide_exchanges(found, "wide") == (1, 1)
    small = lookup_joins(stored, lookups(frames), "id", broadcast_rows=250_000)
    assert wide_exchanges(small, "wide") == (0, 1)


@pytest.fixture(scope="module")
def release(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("release") / "release.parquet")
    standin.records(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_export_is_the_same_with_large_lookups(release, tmp_path):
    plain = export_systems(release, standin.EXPORT)
    written = write_export(release, standin.EXPORT, str(tmp_path / "out"), rows_per_file=300, broadcast_rows=20)
    assert sorted(map(str, written.collect())) == sorted(map(str, plain.collect()))
    files = sorted((tmp_path / "out").glob("part-*"))
    ids = [i for f in files for i in pq.read_table(f).column("tts_row").to_pylist()]
    assert ids == sorted(ids) and len(files) == -(-len(ids) // 300)


def test_export_rows_move_once(release):
    cuts = equal_cuts(pv_rows(release), standin.ROW_ID, 300)
    placed = _attached(release, standin.EXPORT, set(schema.EXPORT_COLUMNS), None, cuts, broadcast_rows=0)
    assert wide_exchanges(placed, "city") == (1, 1)
