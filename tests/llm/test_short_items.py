"""Items of few words: every set of replaced words that the share allows leaves a hit."""

import itertools

import pytest

from coverlens.llm import decontaminate as dc


def hit(n, out):
    return any(
        all(s + i not in out for i, c in enumerate(dc.MASKS[mask]) if c == "1")
        for mask in dc._masks(n)
        for s in range(n - len(dc.MASKS[mask]) + 1)
    )


@pytest.mark.parametrize("n", range(3, 21))
def test_masks_hit_whole_items(n):
    for replaced in range(n * (100 - dc.MIN_SHARE) // 100 + 1):
        assert [out for out in itertools.combinations(range(n), replaced) if not hit(n, out)] == []


def test_short_leaks_are_found(spark):
    items, rows = [], []
    for n in range(3, 13):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for replaced in range(n * (100 - dc.MIN_SHARE) // 100 + 1):
            for out in itertools.combinations(range(n), replaced):
                text = ["x"] * 3 + ["new" if i in out else w for i, w in enumerate(words)] + ["y"] * 3
                rows.append((len(rows), " ".join(text), n))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.overlaps(docs, tests).collect()}
    assert found == {(doc_id, n) for doc_id, _, n in rows}
    assert dc.without_leaks(docs, tests).count() == 0
    only = tests.where("item_id = 10")
    assert {r.doc_id for r in dc.overlaps(docs, only).collect()} == {i for i, _, n in rows if n == 10}
