"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from coverlens.llm import prefixes as operator
from coverlens.llm.queries import ORACLES, QUERIES
from tests.comparing import differences, duck

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    original = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            original.setdefault(conv, []).append((turn is not None, turn or 0, tie, (role, text)))
    original = {c: [t[-1] for t in sorted(turns)] for c, turns in original.items()}
    rebuilt = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(original.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [sums[child] for child in children.get(path, [])]
        saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sums[path] = (sum(s[0] for s in below) or not below, saved + sum(s[1] for s in below))
    for path, convs in nodes.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        own = (min(convs), len(path), parent, len(convs), len(children.get(path, [])))
        out.append((*own, int(sums[path][0]), sums[path][1], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def ours(spark, rows, **options):
    frame = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in operator.trie(frame, **options).select(*COLUMNS).collect()), key=repr)


def some(seed, convs, turns, texts, low=0):
    rng = random.Random(seed)
    rows = []
    for c in range(low, low + convs):
        for turn in range(rng.randrange(1, turns)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, texts, low", [(1, ["a", "ß", "bb"], 0), (2, ["", "x"], -23), (3, ["one"], 10**17)])
def test_against_turn_by_turn(spark, seed, texts, low):
    rows = some(seed, 90, 14, texts, low)
    assert ours(spark, rows) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = some(5, 40, 8, ["a", None, ""])
    rows += [(c, rng.choice([None, 0, 1, 2]), rng.choice([None, "user"]), rng.choice(["a", "b", None])) for c in range(40) for _ in range(3)]
    rows += [(None, 0, "user", "a")] * 3 + rows[:50]
    assert ours(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert ours(spark, []) == []
    rows = some(6, 12, 6, ["a", "b"])
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "'x' AS part", "2 AS depth", "3 AS `a.b`", "4 AS fp1")
    assert ours(spark, frame) == plain(rows)


@pytest.fixture
def many_partitions(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


def test_a_conversation_over_many_partitions(spark, many_partitions):
    """One conversation holds most of the rows; with it the copies that repeat one of its turns."""
    rng = random.Random(7)
    rows = [(5, i, "user", rng.choice("ab")) for i in range(600)] + [(5, None, "user", "same")] * 600
    rows += [(c, i, "user", "same") for c in range(20) if c != 5 for i in range(4)]
    ordered = operator._ordered(spark.createDataFrame(rows, SCHEMA))
    assert ordered.where("conv = 5").select("part").distinct().count() > 2
    assert ours(spark, rows) == plain(rows)


def test_fingerprints_that_collide_are_found_out(spark, monkeypatch):
    tried = []
    own = operator.bases
    monkeypatch.setattr(operator, "bases", lambda seed, prime: tried.append(seed) or (own(seed, prime) if seed > 2 else [1] * 4))
    rows = [(c, i, "user", t) for c, texts in ((40, "ab"), (45, "ba"), (50, "ab")) for i, t in enumerate(["x"] * 8 + list(texts))]
    assert ours(spark, rows) == plain(rows)
    assert tried == [1, 2, 3]  # with base 1 the order of turns does not show


def test_blocks_of_depths_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(operator, "DEPTHS", 3)
    monkeypatch.setattr(operator, "NUMBERS", 4)
    rows = some(8, 60, 25, ["a", "b"]) + [(c, 0, "user", "z") for c in range(100, 160)]
    assert ours(spark, rows) == plain(rows)


def test_query_equals_statement(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES["op13_prefixes"](spark, sf_dir), duck(sf_dir), ORACLES["op13_prefixes"]) == []
