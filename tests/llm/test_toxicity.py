"""Toxicity on held-out rows, on misspellings, and the cases that tables bring along."""

import zlib

import numpy as np
import pytest

from coverlens.llm import toxicity
from coverlens.llm.queries import QUERIES


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op6_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    bad = [r for r in held if r.toxic == 1]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        words = [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfgh"), 60), rng.choice(["ando", "elit", "ipsum", "urna"], 60), strict=True)]
        if i % 4 == 0:
            words[rng.integers(0, 60)] = "horrible"
            words[rng.integers(0, 60)] = "nastyfool"
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (3, None), (99999, 1), (0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_misspellings_and_cases_of_tables(spark, small):
    docs, labels = small
    model = toxicity.fit(docs, labels)
    filler = "bando celit dipsum furna gando helit bipsum curna delit fando " * 4
    texts = {
        1: filler + "horrible nastyfool", 2: filler, 3: filler + "HORRIBLE! nastyfool.", 4: filler + "horriblee nnastyfool",
        5: None, 6: "", 7: "x", 8: filler * 500, None: filler + "horrible nastyfool",
    }
    odd = spark.createDataFrame([(k, v, "y") for k, v in texts.items()] * 2, "doc_id long, text string, body string")
    found = toxicity.score(odd, model).collect()
    assert len(found) == 18 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    predicted = {r.doc_id: r.predicted for r in found}
    assert [k for k in texts if predicted[k]] == [1, 3, 4, None]
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted([2, 5, 6, 7, 8] * 2)


def test_nothing_to_learn_from(spark, small):
    docs, labels = small
    for known in (labels.limit(0), labels.where("toxic = 1")):
        found = toxicity.score(docs, toxicity.fit(docs, known))
        assert found.where("predicted = 1").count() == 0 and found.count() == 600
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
