"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from coverlens.llm import toxicity
from coverlens.llm.queries import TOKENIZER
from tests.llm.test_decontaminate import words_of
from tests.llm.test_pii import plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
        assert name == "packing" or docs.columns == COLUMNS
    return out


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_copies", "decontamination", "personal_data", "packing",
    ]


def test_toxic_documents_go(spark, sf_dir, kept):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [r.text.encode() for r in kept["documents"]]
    clean = {r.doc_id for r, s in zip(kept["documents"], toxicity.scores(texts, model), strict=True) if s < 0.5}
    assert {r.doc_id for r in kept["toxicity"]} == clean


def test_one_of_each_group_stays(kept):
    before, after = ({r.doc_id: shingles(r.text) for r in kept[k]} for k in ("toxicity", "near_copies"))
    alike = lambda a, b: len(a & b) / len(a | b)
    gone = set(before) - set(after)
    assert gone and set(after) < set(before)
    for doc_id in gone:  # a near copy with a smaller id was there
        assert any(alike(before[doc_id], other) > 0.65 for i, other in before.items() if i < doc_id), doc_id
    ids = sorted(after)
    assert not [(a, b) for a in ids for b in ids if a < b and alike(after[a], after[b]) >= 0.95]


def test_leaks_go(spark, sf_dir, kept):
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = {tuple(t.split()[i : i + 5]) for t in items for i in range(len(t.split()) - 4)}
    after = {r.doc_id for r in kept["decontamination"]}
    gone = 0
    for r in kept["near_copies"]:
        words = words_of(r.text)
        whole = any(f" {t} " in f" {' '.join(words)} " for t in items)
        shared = sum(tuple(words[i : i + 5]) in runs for i in range(len(words)))
        gone += r.doc_id not in after
        assert not whole or r.doc_id not in after
        assert shared or r.doc_id in after
    assert gone


def test_personal_data_become_placeholders(kept):
    before = {r.doc_id: r for r in kept["decontamination"]}
    assert set(before) == {r.doc_id for r in kept["personal_data"]}
    for r in kept["personal_data"]:
        assert plain_spans(r.text) == [] and r.n_chars == len(r.text)
        if not plain_spans(before[r.doc_id].text) and "<" not in r.text:
            assert r.text == before[r.doc_id].text
    assert any(re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) for r in kept["personal_data"])


def test_all_texts_are_packed(kept):
    tokenizer, lengths = Tokenizer.from_file(TOKENIZER), defaultdict(int)
    for r in kept["packing"]:
        lengths[r.doc_id] += r.length
    expected = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept["personal_data"]}
    assert lengths == expected
