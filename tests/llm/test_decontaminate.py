"""Leaks against sliding every item along every text, and the masks' guarantee."""

import itertools
import random
import string

import numpy as np
import pytest

from coverlens.llm import decontaminate as dc


def words_of(text):
    kept = "".join(c for c in text if c not in string.punctuation)
    for c in "\t\n\x0b\x0c\r":
        kept = kept.replace(c, " ")
    return [w.lower() for w in kept.split(" ") if w]


def plain(text, item):
    a, b = words_of(text or ""), words_of(item or "")
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [a[i + shift] == b[i] for i in range(max(0, -shift), min(len(b), len(a) - shift))]
        for i in range(len(same)):
            for j in range(i + 1, len(same) + 1):
                if 100 * sum(same[i:j]) >= dc.MIN_SHARE * (j - i):
                    best = max(best, j - i)
    return best if len(b) >= 3 and best >= min(dc.MIN_WORDS, len(b)) else 0


@pytest.mark.parametrize(("n", "replaced"), [(13, 2), (15, 3)])
def test_masks_hit_every_stretch(n, replaced):
    for out in itertools.combinations(range(n), replaced):
        assert any(
            all(s + i not in out for i, c in enumerate(mask) if c == "1")
            for mask in dc.MASKS[:4]
            for s in range(n - len(mask) + 1)
        ), out


def test_longest_overlap():
    rng = np.random.default_rng(8)
    for _ in range(400):
        same = rng.random(rng.integers(1, 30)) < rng.choice([0.5, 0.8, 0.9])
        start, end = dc.longest_overlap(same)
        spans = [(i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 100 * same[i:j].sum() >= 80 * (j - i)]
        assert end - start == max((j - i for i, j in spans), default=0)
        assert end == start or (start, end) in spans


def test_against_sliding(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([4, 10, 16, 25, 40]))), "x") for k in range(25)]
    items += [(90, None, "x"), (91, "", "x"), (92, "One, two. THREE!", "x"), (93, "w1 w2", "x"), (90, None, "x")]
    rows = []
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            leak = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, max(1, len(leak) // 6))):
                leak[rng.randrange(len(leak))] = "new"
            cut = rng.choice([0, 0, 0, 5])
            words[rng.randint(0, len(words)) :] = [w.upper() + rng.choice(["", ",", "!"]) for w in leak[cut:]] + words[:9]
        rows.append((i, " ".join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "x one two three y", "s"), (None, "one two three", "s"), (502, "z", "s"), (502, "z", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seed string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string, words string")
    found = {(r.doc_id, r.item_id): r for r in dc.overlaps(docs, tests).collect()}
    expected = {}
    for doc_id, text, _ in rows:
        for item_id, item, _ in items:
            if n := plain(text, item):
                expected[doc_id, item_id] = max(n, expected.get((doc_id, item_id), 0))
    assert {k: r.n_words for k, r in found.items()} == expected and len(expected) > 30
    for (doc_id, item_id), r in found.items():
        texts = [words_of(t) for i, t, _ in rows if i == doc_id and t]
        item = words_of(dict((i, t) for i, t, _ in items)[item_id])[r.item_start : r.item_start + r.n_words]
        assert r.n_same in [sum(a == b for a, b in zip(t[r.doc_start :], item, strict=False)) for t in texts]
    kept = dc.without_leaks(docs, tests)
    assert kept.columns == docs.columns
    flagged = {(i, t) for i, t, _ in rows if any(plain(t, item) for _, item, _ in items)}
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(repr((i, t)) for i, t, _ in rows if (i, t) not in flagged)


def test_long_items_with_replaced_passages(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(20_000)]
    items, rows, expected = [], [], {}
    for k, n in enumerate([100, 150, 240, 400, 600, 1000]):
        item = rng.choices(vocabulary, k=n)
        items.append((k, " ".join(item)))
        for part, out in enumerate([n // 6, n // 5]):  # adjacent words, all replaced
            at = rng.randint(n // 4, n // 2)
            leak = [*item[:at], *["other"] * out, *item[at + out :]]
            before = rng.choices(vocabulary, k=rng.randint(0, 1500))
            rows.append((10 * k + part, " ".join([*before, *leak, *rng.choices(vocabulary, k=300)])))
            expected[10 * k + part, k] = (len(before), 0, n, n - out)
        # too many: what is left is the longer of two overlaps
        rows.append((10 * k + 2, " ".join([*item[: n // 4], *["other"] * (n // 2), *item[n // 4 + n // 2 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {(r.doc_id, r.item_id): r for r in dc.overlaps(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for key, (doc_start, item_start, n, same) in expected.items():
        r = found[key]
        assert (r.doc_start, r.item_start, r.n_words, r.n_same) == (doc_start, item_start, n, same), (key, r)
    assert set(found) == set(expected) | {(10 * k + 2, k) for k in range(6)}
    texts, tests = dict(rows), dict(items)
    for (doc_id, item_id), r in found.items():
        a, b = texts[doc_id].split(), tests[item_id].split()
        shift = r.doc_start - r.item_start
        same = np.array([a[i + shift] == b[i] for i in range(max(0, -shift), min(len(b), len(a) - shift))])
        begin, end = dc.longest_overlap(same)
        assert (end - begin, int(same[begin:end].sum())) == (r.n_words, r.n_same)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.overlaps(docs.limit(0), items).collect() == []
    assert dc.overlaps(docs, items.limit(0)).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == 1
