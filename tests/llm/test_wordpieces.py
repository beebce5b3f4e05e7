"""Word-piece counts against cutting off the longest piece again and again."""

import random

from coverlens.llm import wordpieces
from coverlens.llm.queries import TOKENIZER


def plain(word, pieces):
    n = 0
    while word:
        for size in range(len(word), 0, -1):
            if word[:size] in pieces:
                break
        else:
            return None
        word, n = word[size:], n + 1
    return n


def test_automaton_on_small_vocabularies():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.choice([2, 3])
        letters = b"abc"[:size]
        pieces = {bytes([c]) for c in letters if rng.random() < 0.9}
        pieces |= {bytes(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(rng.randint(0, 12))}
        counter = wordpieces.PieceCounter(pieces)
        for _ in range(60):
            word = bytes(rng.choices(letters, k=rng.randint(0, 12)))
            expected = plain(word, pieces)
            assert counter[word] == (1 if expected is None else expected), (word, pieces)


def test_documents(spark):
    pieces = wordpieces.vocabulary(TOKENIZER)
    assert len({p for p in pieces if len(p) == 1}) == 256
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcDE étion the\n\t.,😀", k=rng.randint(0, 60))), "x") for i in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "Tion tion", None), (902, "a" * 200_000, "x"), (902, "a" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = wordpieces.token_counts(docs, TOKENIZER)
    expected = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().lower().split()
        expected.append((doc_id, len(words), sum(plain(w, pieces) if len(w) < 1000 else wordpieces.PieceCounter(pieces)[w] for w in words)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert wordpieces.token_counts(docs.limit(0), TOKENIZER).collect() == []


def test_linear_on_long_words():
    counter = wordpieces.PieceCounter({b"a", b"b", b"a" * 50})
    word = b"a" * 300_049
    assert counter[word] == 300_049 // 50 + 300_049 % 50
