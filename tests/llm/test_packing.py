"""Packing: whole texts once each, gapless sequences, few of them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from coverlens.llm import packing
from coverlens.llm.queries import TOKENIZER


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= length]
        if fitting:
            best = min(fitting, key=lambda i: rooms[i])
            rooms[best] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        lengths = [min(capacity, rng.randint(1, rng.choice([3, 10, 40]))) for _ in range(rng.randint(0, 150))]
        runs = packing.plan(Counter(lengths), capacity)
        filled = defaultdict(list)
        ranks = defaultdict(set)
        for length, rank, number, first, offset in runs:
            assert number > 0
            for k in range(number):
                filled[first + k].append((offset, length))
                ranks[length].add(rank + k)
        assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) == plain_best_fit(lengths, capacity)


def test_round_trip(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["the", "of", "Tionea,", "été", "x1!"], k=rng.randint(0, 400))), "a", 1) for i in range(300)]
    rows += [(1000, None, "a", 1), (1001, "", None, None), (1002, "word " * 30_000, "a", 1), (1003, "same", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, part int").repartition(6)
    found = packing.pack(docs, TOKENIZER, 512).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    whole = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    places, ends = defaultdict(list), Counter()
    for r in found:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.start == 512 * r.piece and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        ends[r.doc_id] += r.length
    assert ends == {k: len(v) for k, v in whole.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    cuts = [min(512, len(v) - at) for v in whole.values() for at in range(0, len(v), 512)]
    assert len(places) == plain_best_fit(cuts, 512)
    text = {r.sequence_id: (list(r.ids), list(r.doc_ids)) for r in packing.sequences(docs, TOKENIZER, 512).collect()}
    for r in found:
        assert text[r.sequence_id][0][r.offset : r.offset + r.length] == whole[r.doc_id][r.start : r.start + r.length]


def test_cases_of_tables(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), TOKENIZER).collect() == []
    rows = [(1, "a b"), (1, "a b"), (1, "a c"), (None, "x"), (None, None)]
    found = packing.pack(spark.createDataFrame(rows, schema), TOKENIZER).collect()
    assert len(found) == 5 and {r.sequence_id for r in found} == {found[0].sequence_id}
    assert sorted(r.offset for r in found) == [0, 3, 6, 9, 11]
