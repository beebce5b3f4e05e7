"""Language-model scores: the base by plain counting, the model by its probabilities and slopes."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from coverlens.llm import attention, lm
from coverlens.llm.queries import QUERIES, TOKENIZER


def model(seed=1):
    rng = np.random.default_rng(seed)
    n = attention.GROUP**2
    made = attention.Model(np.log(rng.dirichlet(np.ones(n), n + 1)), seed)
    for name in ("to_group", "to_member", "distance"):
        made.parts[name] = rng.standard_normal(made.parts[name].shape).astype(np.float32) * 0.3
    return made


def plain_log_probabilities(m, tokens):
    """One token at a time, by the windows' definition."""
    out, p = [], m.parts
    line = [m.begin, *tokens]
    for t in range(len(tokens)):
        first = max(0, t // attention.STRIDE * attention.STRIDE - attention.STRIDE + 1)
        seen = line[first : t + 1]
        e = p["embedding"].astype(float)
        query = e[line[t]] @ p["query"] / math.sqrt(attention.WIDTH)
        scores = np.array([query @ (e[c] @ p["key"]) + p["distance"][len(seen) - 1 - j] for j, c in enumerate(seen)])
        weights = np.exp(scores) / np.exp(scores).sum()
        hidden = weights @ np.array([e[c] @ p["value"] for c in seen])
        groups = m.groups[line[t]] + hidden @ p["to_group"]
        group = tokens[t] // attention.GROUP
        members = m.members[line[t], group] + hidden @ p["to_member"][group]
        out.append(groups[group] - np.log(np.exp(groups).sum()) + members[tokens[t] % attention.GROUP] - np.log(np.exp(members).sum()))
    return np.array(out)


def test_windows_score_each_token_once():
    m = model()
    rng = np.random.default_rng(4)
    sizes = np.array([1, 15, 16, 17, 50, 100, 32])
    tokens = rng.integers(0, m.begin, sizes.sum()).astype(np.int32)
    laid, at, place = attention.windows(tokens, sizes, m.begin, m.pad)
    got = m.log_probabilities(laid, at)[place]
    expected = np.concatenate([plain_log_probabilities(m, list(t)) for t in np.split(tokens, np.cumsum(sizes)[:-1])])
    np.testing.assert_allclose(got, expected, rtol=2e-3, atol=2e-3)


def test_probabilities_sum_to_one():
    m = model()
    start = [5, 900, 17]
    total = 0.0
    for last in range(0, m.begin, 1):
        tokens = np.array([*start, last], np.int32)
        laid, at, place = attention.windows(tokens, np.array([4]), m.begin, m.pad)
        total += math.exp(m.log_probabilities(laid, at)[place][-1])
    assert abs(total - 1) < 1e-3


def test_slopes():
    m = model()
    m.parts = {k: v.astype(np.float64) for k, v in m.parts.items()}
    m.groups, m.members = m.groups.astype(np.float64), m.members.astype(np.float64)
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 40, 200).astype(np.int32)
    laid, at, _ = attention.windows(tokens, np.array([200]), m.begin, m.pad)
    block = laid[at[:, None] + np.arange(attention.KEYS + 1)]
    slopes = m.slopes(block)[1]
    for name, part in m.parts.items():
        for index in [tuple(rng.integers(0, s) for s in part.shape) for _ in range(4)] + ([(3, 2)] if part.ndim == 2 else []):
            index = index if name != "embedding" else (int(tokens[rng.integers(0, 200)]), index[1])
            losses = []
            for step in (1e-3, -1e-3):
                part[index] += step
                losses.append(m.slopes(block)[0])
                part[index] -= step
            assert abs((losses[0] - losses[1]) / 2e-3 - slopes[name][index]) < 2e-4, (name, index)


def test_words_are_those_of_the_contract():
    rng = np.random.default_rng(6)
    bits = [b"a", b"B", b" ", b"\t", b"\x0b", b"\x0c", b"\r\n", b"\x1c", b"\x85", "é".encode(), "\u2003".encode(), "É".encode(), b"0"]
    texts = [b"".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 12))) for _ in range(3000)]
    for part in (texts, texts[:1], [b""], [b" "], []):
        column = pa.array([b"skipped", *part], pa.binary()).slice(1)
        sizes, places, words = lm.split_words(column)
        assert len(set(words)) == len(words)
        ends = np.cumsum(sizes)
        assert [[words[p] for p in places[e - n : e]] for e, n in zip(ends, sizes, strict=True)] == [t.lower().split() for t in part]


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op10_language_model"](spark, "/root/testdata/sf0.01").collect()


def test_base_by_plain_counting(spark, scored):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), None] for r in rows}
    counts = Counter(w for k, own in tokens.items() if not held[k] for w in own)
    n, v = sum(counts.values()), len(counts)
    assert len(scored) == len(rows)
    for r in scored:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)


def test_scores_are_those_of_a_language_model(scored):
    per_word = sum(r.score for r in scored if r.held_out) / sum(r.n_tokens for r in scored if r.held_out)
    assert all(r.score < 0 for r in scored) and -5.2 < per_word < -3.5


def test_attention_tells_more_than_the_pairs_of_classes(spark, scored):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alone = lm.score(docs, TOKENIZER, rates=()).where("held_out").collect()
    trained = {r.doc_id: r.score for r in scored}
    words = sum(r.n_tokens for r in alone)
    assert sum(trained[r.doc_id] - r.score for r in alone) / words > 0.1


def test_every_window_of_training_texts_is_trained_on_once(monkeypatch):
    m = model()
    held = [False, True, False]
    texts = [b"a b c " * 40, b"d e " * 30, b"f g h i " * 25]
    batch = lm._chunk(5, [1, 2, 3], held, pa.array(texts, pa.binary()), TOKENIZER)
    row = next(lm._each([batch]))
    words = lm.vocabulary(np.bincount(lm._Texts(row).ids, minlength=row["vocabulary"]))
    seen = []
    monkeypatch.setattr(attention.Model, "train", lambda self, blocks, rate: [seen.extend(map(tuple, b)) for b in blocks] and 1)
    for turn in range(3):
        list(lm._train_part(m, words, 0.01, turn, 3)([batch]))
    own = lm._Texts(row)
    tokens, sizes = own.training(words.class_of[own.ids])
    laid, at, _ = attention.windows(tokens, sizes, m.begin, m.pad)
    assert sorted(seen) == sorted(map(tuple, laid[at[:, None] + np.arange(attention.KEYS + 1)]))


def test_ids_beyond_16_bits():
    assert lm._kind_of_id(65_536) == "<u2" and lm._kind_of_id(65_537) == "<u4"
    row = next(lm._each([lm._chunk(0, [1], [False], pa.array([b"a b"], pa.binary()), TOKENIZER)]))
    wide = np.frombuffer(row["ids"], "<u2").astype("<u4") + 70_000
    texts = lm._Texts({**row, "ids": wide.tobytes(), "vocabulary": 200_000})
    assert texts.ids.min() >= 70_000 and len(texts.ids) == 3


def test_cases_of_tables(spark):
    rows = [(1, "Some text here", "x"), (1, "Some text here", "x"), (None, "some words", None), (2, None, "x"), (3, "", "x"), (4, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    found = lm.score(docs, TOKENIZER).collect()
    assert len(found) == 6
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].n_tokens == by_id[3].n_tokens == 1 and by_id[2].score == by_id[3].score < 0
    assert by_id[4].n_tokens == 50_001 and not by_id[None].held_out
    assert lm.score(docs.limit(0), TOKENIZER).collect() == []


def test_slopes_are_summed_by_class():
    rng = np.random.default_rng(8)
    for n in (1, 7, 4000):
        rows, at = rng.standard_normal((n, 5)).astype(np.float32), rng.integers(0, 1026, n).astype(np.int32)
        expected = np.zeros((1026, 5), np.float32)
        np.add.at(expected, at, rows)
        np.testing.assert_allclose(attention._summed(rows, at, 1026), expected, atol=1e-4)


def test_steps_of_training_lower_the_loss_and_stay_finite():
    m = model()
    tokens = np.random.default_rng(9).integers(0, 40, 4000).astype(np.int32)
    laid, at, _ = attention.windows(tokens, np.array([4000]), m.begin, m.pad)
    block = laid[at[:, None] + np.arange(attention.KEYS + 1)]
    own = m.copy()
    assert own.train(iter([block] * 20), 0.02) == 20 * len(block)
    assert own.slopes(block)[0] < m.slopes(block)[0] - 0.5
    own.parts["to_group"] = own.parts["to_group"] * np.float32(1e4)
    own.train(iter([block] * 3), 0.02)
    assert np.isfinite(own.flat()).all()


def test_rows_of_chunks_come_as_arrays():
    batch = lm._chunk(0, [1, None], [False, True], pa.array([b"a b", b"c"], pa.binary()), TOKENIZER)
    row = next(lm._each([batch]))
    assert isinstance(row["keys"], np.ndarray) and isinstance(row["sizes"], np.ndarray)
    assert row["doc_ids"] == [1, None] and list(row["held"]) == [False, True]


def test_a_task_holds_one_chunk_at_a_time(spark, monkeypatch, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from coverlens.llm import common, tokens

    paths = []
    new_path = common.new_path
    monkeypatch.setattr(common, "new_path", lambda spark, name: paths.append((name, new_path(spark, name))) or paths[-1][1])
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100)
    docs = spark.createDataFrame([(i, f"words of text number {i} " * 10) for i in range(40)], "doc_id long, text string").coalesce(1)
    found = lm.score(docs, TOKENIZER, rates=())
    (folder,) = [path.removeprefix("file:") for name, path in paths if name == "chunks"]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    assert sum(f.num_rows for f in files) == sum(f.num_row_groups for f in files) == 40
    # a chunk is a group of its own, not one of many rows in a batch
    assert "CoGroups" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in found.collect()) == list(range(40))
    # and what the tokenizer remembers is gone when chunks are read
    tokens.ChunkTokenizer.of(TOKENIZER).learn([b"some", b"words"])
    assert tokens._LOADED
    list(lm._each([]))
    assert not tokens._LOADED
