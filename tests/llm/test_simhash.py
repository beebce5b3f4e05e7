"""SimHash near copies against comparing every pair, and the cases that tables bring along."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coverlens.llm import simhash
from coverlens.llm.components import components


def plain_fingerprint(text):
    table = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.translate(table).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, reach=2):
    prints = {i: plain_fingerprint(t or "") for i, t in rows}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= reach:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, f"{prints[i]:016x}", top(i)) for i in prints}


def test_against_every_pair(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "ONE  two"), (6, "é É\x1c x")]
    base = [f"w{i}" for i in rng.integers(0, 400, 300)]
    for i in range(10, 130):
        words = list(base)
        for at in rng.integers(0, 300, i // 20):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    rows.append((500, "long " * 60_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = simhash.near_copies(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in found.collect()} == plain_components(rows)


def test_cases_of_tables(spark):
    schema = "doc_id long, text string, fp long, fingerprint string, root int"
    assert simhash.near_copies(spark.createDataFrame([], schema)).collect() == []
    rows = [(4, "same text here", 1, "a", 2), (4, "same text here", 1, "a", 2), (None, "same text here", 1, "a", 2)]
    docs = spark.createDataFrame(rows, schema)
    found = simhash.near_copies(docs).collect()
    assert len(found) == 3 and {r.component_id for r in found} == {4}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [None]
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_one_of_each_similar_group_stays(spark):
    rng = np.random.default_rng(7)
    rows, heads = [], set()
    for g in range(60):
        base = [f"w{i}" for i in rng.integers(0, 3000, 200)]
        heads.add(10 * g)
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):  # two of 200 words replaced: a similarity of about 0.9
            words = list(base)
            for at in rng.choice(200, 2, replace=False):
                words[at] = f"x{g}.{k}"
            rows.append((10 * g + k, " ".join(words)))
    rows += [(9000, "w1"), (9001, "w2 w3"), (9002, ""), (9003, None), (9004, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept >= heads | {9000, 9001, 9002}
    assert len(kept - heads - {9000, 9001, 9002}) <= 3 and not kept & {9003, 9004}


def test_dense_group_is_one_component():
    rng = np.random.default_rng(2)
    points = np.uint64(2**40 + 12345) ^ (np.uint64(1) << rng.integers(0, 20, 6000, dtype=np.uint64))
    points = np.concatenate([points, rng.integers(0, 2**63, 500, dtype=np.uint64)])
    root = simhash.forest(points, 2)
    assert (root[:6000] == 0).all() and len(np.unique(root[6000:])) == 500


@pytest.mark.parametrize("reach", [0, 1, 2, 5])
def test_tree_loses_no_pair(reach):
    rng = np.random.default_rng(reach)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(
        np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)])
    )
    points = np.unique(np.concatenate([points, rng.integers(0, 2**63, 3000, dtype=np.uint64)]))
    found = set()
    for left, right in simhash.close_pairs(points, reach):
        found |= set(zip(np.minimum(left, right).tolist(), np.maximum(left, right).tolist(), strict=True))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= reach
    assert found == {(int(a), int(b)) for a, b in np.argwhere(near) if a < b}


def test_distributed_links_are_all_links(spark):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 300, dtype=np.uint64)
    points = np.unique(
        np.concatenate([center ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(9)])
    )
    table = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    pairs = simhash.links(table, 2, every_pair=True, shard_rows=64, sample_rows=600)
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    signed = points.view(np.int64)
    expected = {tuple(sorted((int(signed[a]), int(signed[b])))) for a, b in near if a < b}
    rows = [tuple(r) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, i) for i in range(1001, 1400)]
    noise = [(5, 5), (1, 0), (2000, 1399)]
    found = components(spark.createDataFrame(chain + hub + noise, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in [*range(1001, 1400), 2000]}
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).collect() == []
