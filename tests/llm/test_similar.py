"""Near copies by similarity against all pairs of texts."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from coverlens.llm import simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(one, two):
    return 5 * len(one & two) >= 4 * len(one | two)


def plain_groups(texts):
    """The least position linked with each one."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))]


def family(rng, kind, n, vocabulary):
    """A text and copies around a similarity of 0.8, both sides of it."""
    base = rng.choices(vocabulary, k=n)
    out = [base]
    for _ in range(3):
        copy, change = list(base), rng.uniform(0.02, 0.3)
        if kind == "scattered":
            for at in rng.sample(range(n), max(1, int(n * change / 8))):
                copy[at] = rng.choice(vocabulary)
        elif kind == "appended":
            copy += rng.choices(vocabulary, k=int(n * change))
        elif kind == "trimmed":
            copy = copy[int(n * change) :]
        else:  # the same words in another order
            cut = rng.randrange(n)
            copy = copy[cut:] + copy[:cut]
        out.append(copy)
    return [" ".join(words) for words in out]


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for kind in ("scattered", "appended", "trimmed", "turned"):
        for _ in range(40):
            texts += family(rng, kind, rng.randint(8, 300), vocabulary)
    line = " ".join(rng.choices(vocabulary, k=30))  # a common passage, in texts of about its length
    texts += [" ".join([line, *rng.choices(vocabulary, k=rng.randint(3, 20))]) for _ in range(80)]
    texts += ["one two", "ONE\ttwo ", "one two three", None, "", " "]
    rows = [(i, text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    return texts, [found[i] for i in range(len(texts))]


def test_every_pair_at_the_similarity_is_linked(grouped):
    texts, group = grouped
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    assert len(pairs) > 200 and not [p for p in pairs if group[p[0]] != group[p[1]]]


@pytest.mark.parametrize("common", [0, 50, 400])
def test_sets_of_the_similarity_share_a_first_shingle(common):
    rng = np.random.default_rng(common)
    shared = np.unique(rng.integers(0, 2**63, common, dtype=np.uint64))
    for _ in range(200):
        base = rng.permutation(np.concatenate([shared[:30], rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)]))
        more = rng.integers(0, 2**63, len(base) // 4, dtype=np.uint64)
        sets = [np.unique(base), np.unique(np.concatenate([base, more]))]
        sets.append(np.unique(base[: -(-len(base) * 4 // 5)]))
        first, owner = simhash.prefixes(sets, shared, rng.integers(3, 9, len(shared)), Fraction(4, 5))
        first = [set(first[owner == i].tolist()) for i in range(3)]
        assert first[0] & first[1] and first[0] & first[2]


def test_groups_hold_no_pairs_below_the_similarity(grouped):
    texts, group = grouped
    expected = plain_groups(texts)
    first = {}
    assert [first.setdefault(g, i) for i, g in enumerate(group)] == expected
    assert len(set(expected)) > 200


def test_only_copies_at_the_similarity_go(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(2000)]
    texts = [text for _ in range(40) for text in family(rng, "scattered", rng.randint(40, 200), vocabulary)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(plain_groups(texts)) and len(kept) < len(texts)


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 5, 300, 9000):
        one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[n // 9 :], rng.integers(0, 2**63, n // 8, dtype=np.uint64)]))
        bits = [np.frombuffer(simhash.sketch(x), np.uint8) for x in (one, two)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, two))


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"word{i}" for i in range(40))
    names = "doc_id long, text string, _row_hash string, _nth string, `a.b` int, id int, hash int, nth int, row string"
    rows = [(2, text, "keep", "me", 7, 1, 2, 3, "x"), (1, text, "keep", "me", 8, 4, 5, 6, "y"), (3, None, "k", "n", 9, 7, 8, 9, None)]
    docs = spark.createDataFrame(rows, names)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows[1:]))
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_fingerprints_give_the_first_pairs(spark, monkeypatch):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    one, two = ["x", "y", "z"] * 200, ["p", "q", "r"] * 200  # the fingerprint is theirs, whatever follows
    texts = [one + words("a", 20), one + words("a", 21), two + words("b", 20), two + words("c", 20), words("d", 200)]
    texts = [" ".join(text) for text in texts]
    points = [simhash.fingerprint(text.encode()) for text in texts]
    apart = lambda i, j: (points[i] ^ points[j]).bit_count()
    assert max(apart(0, 1), apart(2, 3)) <= simhash.REACH < min(apart(0, 2), apart(0, 4), apart(2, 4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    nothing = lambda texts, marked, similarity: marked.where("false").selectExpr("0L meeting", "node", "size")
    monkeypatch.setattr(simhash, "prefix_meetings", nothing)
    alone = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    for group in (whole, alone):  # linked by their fingerprints, but only at the similarity
        assert group[0] == group[1] and len(set(group.values())) == 4


def test_fingerprint_meetings_against_all_pairs(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(100, 400))
        texts += [" ".join(base), " ".join([*base, "end"]), " ".join(["begin", *base, "end"]), " ".join(base[:50])]
    points = [simhash.fingerprint(text.encode()) for text in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= simhash.REACH and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    nodes = [simhash._node(simhash.shingle_set(text.encode())) for text in texts]
    expected = {frozenset(n for n, r in zip(nodes, root, strict=True) if r == one) for one in root}
    rows = [(n - (n >> 63 << 64), p - (p >> 63 << 64), 1) for n, p in zip(nodes, points, strict=True)]
    marked = spark.createDataFrame(rows, "node long, fp long, size long")
    found = {}
    for r in simhash.fingerprint_meetings(marked).collect():
        found.setdefault(r.meeting, set()).add(r.node % 2**64)
    several = {group for group in expected if len(group) > 1}
    assert several and set(map(frozenset, found.values())) == several


def test_sketches_of_long_sets_tell_them_apart():
    rng = np.random.default_rng(5)
    for n, m in ((6000, 6000), (9000, 8000), (300, 250), (40, 50)):
        one, two = (np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        far = simhash.sketch_distances([simhash.sketch(one)], [simhash.sketch(two)])[0]
        assert far <= n + m and (n + m - far) * 5 < (n + m + far) * 4  # no candidate, as nothing is shared
    one = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    more = np.unique(np.concatenate([one, rng.integers(0, 2**63, 600, dtype=np.uint64)]))
    sketches = [simhash.sketch(x) for x in (one, more)]
    assert len(sketches[0]) < len(sketches[1])  # the longer one is folded
    far = simhash.sketch_distances([*sketches, sketches[0]], [*sketches[::-1], sketches[0]])
    assert 0 < far[0] <= 600 and far.tolist() == [far[0], far[0], 0]


def test_long_texts_are_compared_in_parts():
    texts = [" ".join(f"w{i}" for i in range(k, k + 40_000)).encode() for k in range(0, 200, 10)]
    batch = pa.record_batch([list(range(20)), list(range(20, 40)), texts, texts[1:] + [b"other"]], ["a", "b", "body_a", "body_b"])
    parts = list(simhash._alike(Fraction(4, 5))(iter([batch])))
    assert len(parts) > 1 and [a for p in parts for a in p.column("a").to_pylist()] == list(range(19))
