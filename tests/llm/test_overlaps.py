"""The n-gram join against comparing every pair of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlens.llm import overlaps as operator
from coverlens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def shingles(text, words=3):
    found = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def plain(rows, percent=90):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
                if a != b:
                    pairs.add(frozenset((a, b)))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = [(d, len(sets[i]), least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=repr), len(pairs)


def ours(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in operator.join(frame, **options).collect()), key=repr)
    return found, operator.pairs(frame, **options).count()


def corpus(seed, n, sizes, edits):
    """Texts, and copies with so many words replaced, put in, or taken out at the end."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    while len(texts) < n:
        own = [rng.choice(words) for _ in range(rng.choice(sizes))]
        texts.append(own)
        for _ in range(rng.randrange(5)):
            copy = list(own)
            for _ in range(rng.choice(edits)):
                at = rng.randrange(len(copy)) if copy else 0
                kind = rng.randrange(3)
                copy[at : at + (kind != 1)] = [rng.choice(words)] if kind != 2 else []
            texts.append(copy[: len(copy) - rng.choice([0, 0, 1, len(copy) // 12])])
            if rng.random() < 0.5:
                own = copy  # a chain
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, sizes, edits", [(1, range(0, 40), (0, 1, 2)), (2, (60, 200, 450), (0, 1, 3, 6, 9)), (3, (2, 11, 12, 22, 30), (0, 1))])
def test_against_every_pair(spark, seed, sizes, edits):
    rows = corpus(seed, 260, sizes, edits)
    expected = plain(rows)
    assert expected[1] > 10
    assert ours(spark, rows) == expected


def test_large_units_in_parts_and_without_broadcast(spark):
    rng = random.Random(5)
    own = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # one group of different near copies
        copy = list(own)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(own)) for i in range(200, 260)]
    rows += corpus(6, 60, (30, 80), (0, 1))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert ours(spark, rows, part_tokens=2000, broadcast_docs=0) == plain(rows)


def test_nulls_empty_texts_ties_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = " ".join(f"w{i}" for i in range(31))
    rows = [(5, text), (5, text), (3, near), (None, near), (None, None), (None, "only here"), (7, ""), (8, " \t\n"), (7, "")]
    rows += [(9, "One  two"), (10, "one\ttwo"), (11, "one two three"), (12, "ONE TWO THREE"), (13, None), (1, "É b c"), (2, "é b c")]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, []) == ([], 0)


def test_sets_known_by_null_ids_alone(spark):
    texts = [" ".join([f"w{i}" for i in range(40 + n)]) for n in range(4)]
    rows = [(None, t) for t in texts] + [(4, texts[2])]
    assert ours(spark, rows)[0] == plain(rows)[0]


def test_clashing_columns_are_ignored(spark):
    rows = corpus(8, 40, (20, 50), (0, 1))
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit(1), "n": F.lit("x"), "places": F.lit(2), "a.b": F.lit(3), "unit": F.lit(4)})
    assert sorted((tuple(r) for r in operator.join(frame).collect()), key=repr) == plain(rows)[0]


def test_names_that_collide_are_found_out(spark, monkeypatch):
    rows = corpus(9, 40, (20, 30), (0, 1))
    own, tried = operator.described, []

    def described(docs, words, percent, seed):
        tried.append(seed)
        found = own(docs, words, percent, seed)
        return found.withColumn("a", F.lit(1).cast("long")) if seed < 2 else found

    monkeypatch.setattr(operator, "described", described)
    assert ours(spark, rows)[0] == plain(rows)[0]
    assert tried[:2] == [1, 2]


def test_every_linked_pair_shares_a_place():
    rng = np.random.default_rng(4)
    for n in [*range(9, 60), 90, 300, 1000, 5000]:
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for _ in range(20):
            apart = n // 9  # 100 |A and B| = 90 |A or B| at most
            lost = rng.integers(0, apart + 1)
            kept = np.delete(own, rng.choice(n, lost, replace=False))
            new = rng.integers(0, 1 << 64, apart - lost, np.uint64)
            other = np.unique(np.concatenate([kept, new]))
            common = len(np.intersect1d(own, other))
            if 100 * common >= 90 * (len(own) + len(other) - common):
                assert len(np.intersect1d(operator.places(own), operator.places(other)))


def test_sets_with_many_empty_bands_share_a_place():
    rng = np.random.default_rng(5)
    own = np.sort(rng.integers(0, 1 << 60, 200, np.uint64))  # all tokens in a sixteenth of the bands
    assert len(np.intersect1d(operator.places(own), operator.places(own[20:]))) > 0


def test_boxes_rule_pairs_out():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 64, int(n), np.uint64)) for n in rng.integers(100, 400, 600)]
    sets += [s[3:] for s in sets[:20]]
    tree = operator.CountTree(operator._counts(sets, 512))
    leaves = list(operator.near_leaves(tree, tree, 90))
    assert sum(len(a) * len(b) for a, b in leaves) < 0.5 * len(sets) ** 2 / 2
    found = {(min(i, j), max(i, j)) for a, b, _ in operator.linked_pairs(sets, None, 90) for i, j in zip(a, b, strict=True)}
    assert found == {(i, 600 + i) for i in range(20)}


def test_query_on_the_test_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_ngram_join"](spark, sf_dir).collect()), key=repr) == plain(rows)[0]
