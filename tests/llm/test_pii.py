"""Personal data against the contract's patterns in Python's re, and contexts on a planted corpus."""

import hashlib
import random
import re

from coverlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digest(pii.spans(docs)).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        spans, row = plain_spans(text or ""), found[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (text, spans, row)
        counts = [sum(s.startswith(k) for s in spans) for k in PLAIN]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(spans) <= set(row.spans.split(",")) | {""}


def test_fixed_patterns(spark):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "22", "333", "4111111111111111", "4111 1111 1111 1111", "+", "+1",
            "(555)", "é", "😀", "\n", "256", "10.0.0.1", "%", "_", "00", "5500-0000-0000-0004", "  ", "12", "..", "𝟙", "٣"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for i in range(4000)]
    rows += [(9000, None), (9001, ""), (9002, "4111111111111111"), (9003, "a@b.c%d@e.f a@b@c.d x@y.z-"), (9004, "1.2.300.4.5.6.7")]
    check(spark, rows)


def test_long_texts_take_linear_time(spark):
    n = 60_000
    rows = [(1, "a" * n), (2, "1" * n), (3, "1 " * n), (4, "1." * n), (5, "a." * n + "@"), (6, "+1" + "(" * n), (7, "a@" + "b." * n)]
    rows += [(8, "1-" * n + "x 10.1.2.3"), (9, "x@y.zz " * 2000)]
    check(spark, rows)


def test_many_matches_in_one_text(spark):
    """More matches than a block holds, their places near the borders of chunks, and candidates between them."""
    rng = random.Random(8)
    words = ["a@b.cd", "10.1.2.3", "+1 555 010 9999", "é😀", "id-12345", "4111111111111111", "word"]
    mixed = " ".join(rng.choice(words) for _ in range(3000))
    check(spark, [(1, mixed), (2, "x@y.zz " * 50_000), (3, "".join(f"{i}0000 " for i in range(20_000)))])


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((i, f"word{i} more words write to user{i}@host{i}.example.com and go on"))
        rows.append((100 + i, f"at {rng.randint(1, 99)}.2.3.{i} the and a{i}b@c.de the and 4111111111111111 the"))
    rows.append((500, "please write to user.5000(at)host.example today"))
    rows.append((501, "nothing and 123456789 here; it is to 55555555"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest(pii.spans(docs)).collect()}
    text = dict(rows)[500]
    start = text.index("user.5000")
    assert found[500] == f"email:{start}:{start + len('user.5000(at)host.example')}"
    assert found[501] == "" or "email:4" not in found[501]


def test_redaction_and_cases_of_tables(spark):
    schema = "doc_id long, text string, n_chars long, kind string, start int, base array<int>"
    rows = [
        (1, "mail a@b.cd, call +1 (555) 010-9999 now", 39, "k", 1, [1]),
        (1, "mail a@b.cd, call +1 (555) 010-9999 now", 39, "k", 1, [1]),
        (None, "10.1.2.3", 8, None, None, None),
        (3, None, None, None, None, None),
        (4, "", 0, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    clean = "mail <EMAIL>, call <PHONE> now"
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=repr)
    assert texts == sorted([(1, clean, len(clean)), (1, clean, len(clean)), (None, "<IP>", 4), (3, None, None), (4, "", 0)], key=repr)
    assert pii.spans(docs.limit(0)).collect() == []
