"""Subword ids by chunks against the tokenizer itself on whole texts."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from coverlens.llm import tokens
from coverlens.llm.queries import TOKENIZER

ODD = ["a", "B", "é", "é", "́", " ", "\n", "\t", " ", "　", "'", "'s", "'S", "’", "<|endoftext|>",
       "<|ENDOFTEXT|>", "<|startoftext|>", "1", "23", "Σ", "ς", "İ", "ﬁ", "😀", "!", ".", ",", "...", "$", "__", "\x1c",
       "\x85", "​", "中", "文", "\r", "\x0b", "\x0c", "\x00", "</w>", "Ⅷ", "…", "<", "|", "-", "the", "THE"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_odd_texts(tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 9))) for _ in range(8000)]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = tokens.ChunkTokenizer.of(TOKENIZER).encode([t.encode() for t in texts])
    for text, ids, raw in zip(texts, expected, found, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids, repr(text)


def test_memory_is_bounded_and_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    own = tokens.ChunkTokenizer(TOKENIZER)
    for text in ("one two three four five", "six one. two! Three", "", " \n ", "x" * 50_000):
        (raw,) = own.encode([text.encode()])
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_in_use_are_kept_as_others_go(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 6)
    own, encoded = tokens.ChunkTokenizer(TOKENIZER), []
    plain = own._encode
    own._encode = lambda parts: encoded.extend(parts) or plain(parts)
    most = 0
    for n in range(40):
        own.encode([f"often new{n} other{n}".encode()])
        most = max(most, len(own.known | own.before))
    assert encoded.count(b"often") == 1 and len(encoded) >= 81
    assert most <= 12
