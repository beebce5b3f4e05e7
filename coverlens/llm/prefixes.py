"""Prefix trie of conversations that are rebuilt from another one's head and their own tail.

The first turns of a sequence have the fingerprint G = t1 B + t2 B^2 + ... over a prime field, in four
independent bases, t being digits of the turn's SHA-256. Sequences with such fingerprints form a monoid:
x followed by y has G(x) + B^|x| G(y). So a long conversation is fingerprinted in parts that are combined
afterwards, and a rebuilt prefix, L turns of a base and the own turns from the h-th on, has
G(base, L) + B^(L - h) (G(own, k) - G(own, h)): no rebuilt sequence is ever made, and no text leaves the
scan that reads it.

Equal fingerprints propose a node. A node holds only if its members agree on the parent node and on the
SHA-256 of the turn that each refers to; if any does not, everything is done again with other bases.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, written

PRIME = (1 << 31) - 1
BASES = 4
#: Conversations of a run share the head of the one whose number is the run's first.
RUN = 5
#: The head has between 0 and HEAD - 1 turns, by the CRC-32 of the conversation's number.
HEAD = 9
SEED = 1
#: Depths of one block of a running sum.
DEPTHS = 4096
#: Numbers of one block of a list that is hashed.
NUMBERS = 1 << 16
_G = [f"g{i}" for i in range(BASES)]
_E = [f"e{i}" for i in range(BASES)]
_PREFIX = "conv long, place long, part int, bytes long, key1 long, key2 long, " + ", ".join(f"{c} int" for c in _G + _E)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes): what is needed of each turn, its text hashed by the JVM."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps (ab, c) and (a, bc) apart
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def bases(seed: int, prime: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(2, prime - 1) for _ in range(BASES)]


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 .. base^n, by doubling."""
    out = np.ones(n + 1, np.uint64)
    done = 1
    while done <= n:
        take = min(done, n + 1 - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += take
    return out


def _scan(own: list[int], prime: int):
    """Turns in order -> their place in the conversation and G so far, both within this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reached, sums = None, 0, np.zeros(BASES, np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy()
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            start = np.nonzero(first)[0]
            goes_on = current is not None and conv[0] == current
            begin = np.repeat(start, np.diff(np.append(start, n)))
            local = np.arange(n) - begin + 1
            opening = begin == 0
            place = local + np.where(opening, reached, 0) if goes_on else local
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u4").reshape(n, 8)
            columns = [batch.column("conv"), pa.array(place), batch.column("part"), batch.column("bytes")]
            halves = digest[:, 4:].astype(np.uint64)
            keys = (halves[:, ::2] << np.uint64(32) | halves[:, 1::2]).view(np.int64)
            columns += [pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())]
            so_far, terms = [], []
            for i, base in enumerate(own):
                power = _powers(base, n, prime)[local]
                if goes_on:
                    power[opening] = power[opening] * np.uint64(pow(base, reached, prime)) % np.uint64(prime)
                term = digest[:, i].astype(np.uint64) % np.uint64(prime) * power % np.uint64(prime)
                total = np.cumsum(term)
                before = total[begin] - term[begin]
                total = total - before
                if goes_on:
                    total[opening] += sums[i]
                total %= np.uint64(prime)
                so_far.append(total)
                terms.append(term)
            current, reached = conv[-1], int(place[-1])
            sums = np.array([g[-1] for g in so_far], np.uint64)
            columns += [pa.array(g.astype(np.int32)) for g in so_far + terms]
            yield pa.record_batch(columns, ["conv", "place", "part", "bytes", "key1", "key2", *_G, *_E])

    return run


def _modulo(x: Column, prime: int) -> Column:
    return F.pmod(x, F.lit(prime).cast("long"))


def prefixes(own_turns: DataFrame, own_bases: list[int], prime: int) -> DataFrame:
    """(conv, pos, bytes, key1, key2, g*, e*): G of the first `pos` turns, and the last turn's term of it.

    `own_turns` are turns in order with the partition `part` that each is in. A conversation may run
    over several partitions: its parts are scanned apart and shifted by what lies before them. Only
    the first and last conversation of a partition can be such, so that table has a row or two a partition.
    """
    scanned = written(map_arrow(own_turns, _scan(own_bases, prime), _PREFIX), "scanned")
    edges = scanned.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    edges = edges.select(F.explode(F.array("low", "high")).alias("conv"))
    shared = edges.groupBy("conv").count().where("count > 1").select("conv")
    ends = scanned.join(F.broadcast(shared), "conv", "left_semi").groupBy("conv", "part")
    ends = ends.agg(F.max(F.struct("place", *_G)).alias("end")).select("conv", "part", "end.*")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("place").over(earlier), F.lit(0)))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column("before").to_pylist()
            columns = [batch.column(c) for c in ("conv", "part", "before")]
            powers = [[pow(base, n, prime) for n in before] for base in own_bases]
            for name, power in zip(_G, powers, strict=True):
                moved = [g * p % prime for g, p in zip(batch.column(name).to_pylist(), power, strict=True)]
                columns.append(pa.array(moved, pa.int64()))
            columns += [pa.array(power, pa.int64()) for power in powers]
            names = ["conv", "part", "before", *_G, *[f"p{i}" for i in range(BASES)]]
            yield pa.record_batch(columns, names)

    kinds = ", ".join(f"{c} long" for c in [*_G, *[f"p{i}" for i in range(BASES)]])
    moved = map_arrow(ends.select("conv", "part", "before", *_G), shift, f"conv long, part int, before long, {kinds}")
    offsets = moved.select(
        F.col("conv").alias("_conv"),
        F.col("part").alias("_part"),
        "before",
        *[f"p{i}" for i in range(BASES)],
        # sums of numbers below 2^31 over the partitions of a table
        *[F.coalesce(F.sum(g).over(earlier), F.lit(0)).alias(f"o{i}") for i, g in enumerate(_G)],
    )
    match = (F.col("conv") == F.col("_conv")) & (F.col("part") == F.col("_part"))
    placed = scanned.join(F.broadcast(offsets), match, "left")

    def shifted(name: str, i: int, also: Column | None = None) -> Column:
        value = _modulo(F.col(name) * F.col(f"p{i}"), prime)
        value = value if also is None else _modulo(value + also, prime)
        return F.coalesce(value, F.col(name).cast("long")).cast("int").alias(name)

    return placed.select(
        "conv",
        (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"),
        "bytes",
        "key1",
        "key2",
        *[shifted(g, i, F.col(f"o{i}")) for i, g in enumerate(_G)],
        *[shifted(e, i) for i, e in enumerate(_E)],
    )


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD).cast("long")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv, first, length, head, h, g_own): how each conversation is put together, none of it done.

    `head` holds the base's turns that are taken over, at most HEAD - 1; `g_own` is G of the own turns
    that they replace; `length` counts the rebuilt turns.
    """
    early = F.when(F.col("pos") < HEAD, F.struct("pos", "bytes", "key1", "key2", *_G, *_E))
    about = own.groupBy("conv").agg(F.max("pos").alias("n"), F.collect_list(early).alias("early"))
    h = head_length(F.col("conv"))
    about = about.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % RUN, "early": F.sort_array("early")})
    of_base = about.where(F.col("conv") % RUN == 0).select(F.col("conv").alias("base"), F.col("early").alias("head"))
    joined = about.join(of_base, "base", "left")
    head = F.filter(F.coalesce("head", F.slice("early", 1, 0)), lambda t: t["pos"] <= F.col("h"))
    replaced = F.get(F.filter("early", lambda t: t["pos"] == F.col("h")), F.lit(0))
    zero = F.struct(*[F.lit(0).alias(g) for g in _G])
    g_own = F.when((F.col("h") > 0) & (F.col("n") >= F.col("h")), F.struct(*[replaced[g].alias(g) for g in _G]))
    joined = joined.select("conv", "n", "h", head.alias("head"), F.coalesce(g_own, zero).alias("g_own"))
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return joined.select("conv", "h", "head", "g_own", length.cast("long").alias("length"))


def _node(parts: list[Column]) -> list[Column]:
    """Four numbers below 2^31 as two longs."""
    return [F.shiftleft(parts[i].cast("long"), 32).bitwiseOR(parts[i + 1].cast("long")) for i in (0, 2)]


_NODE = ["fp1", "fp2"]
_UP = ["up1", "up2"]


def members(own: DataFrame, plans: DataFrame, own_bases: list[int], prime: int) -> DataFrame:
    """One row per conversation and rebuilt prefix: node, parent, and the turn it refers to.

    (conv, depth, ends, bytes, key1, key2, fp1, fp2, up1, up2)
    """
    turn = ["bytes", "key1", "key2"]

    def row(depth: Column, values: list[Column], now: list[Column], before: list[Column]) -> list[Column]:
        out = [F.col("conv"), depth.cast("long").alias("depth"), (depth == F.col("length")).alias("ends"), *values]
        return out + [c.alias(name) for c, name in zip(_node(now) + _node(before), _NODE + _UP, strict=True)]

    nothing = [F.lit(0)] * BASES
    no_turn = [F.lit(0).cast("long").alias(c) for c in turn]
    roots = plans.select(*row(F.lit(0), no_turn, nothing, nothing))

    heads = plans.select("conv", "length", F.explode("head").alias("t"))
    now = [F.col(f"t.{g}").cast("long") for g in _G]
    before = [_modulo(g - F.col(f"t.{e}"), prime) for g, e in zip(now, _E, strict=True)]
    heads = heads.select(*row(F.col("t.pos"), [F.col(f"t.{c}") for c in turn], now, before))

    # B^(L - h) for h - L = 0 .. HEAD - 1
    shifts = [F.array(*[F.lit(pow(b, -n, prime)).cast("long") for n in range(HEAD)]) for b in own_bases]
    size = F.size("head")
    tail_plans = plans.select(
        F.col("conv").alias("_conv"),
        "h",
        "length",
        size.alias("taken"),
        *[F.when(size > 0, F.get("head", size - 1)[g]).otherwise(0).cast("long").alias(f"h{g}") for g in _G],
        *[F.col(f"g_own.{g}").cast("long").alias(f"o{g}") for g in _G],
        *[F.get(s, (F.col("h") - size).cast("int")).alias(f"s{i}") for i, s in enumerate(shifts)],
    ).where("length > taken")
    # a long conversation's turns meet one row; adaptive execution splits such a partition
    tails = own.join(tail_plans, (F.col("conv") == F.col("_conv")) & (F.col("pos") > F.col("h")))
    now, before = [], []
    for i, (g, e) in enumerate(zip(_G, _E, strict=True)):
        apart = _modulo(F.col(g).cast("long") - F.col(f"o{g}"), prime)
        now.append(_modulo(F.col(f"h{g}") + _modulo(apart * F.col(f"s{i}"), prime), prime))
        before.append(_modulo(now[i] - _modulo(F.col(e).cast("long") * F.col(f"s{i}"), prime), prime))
    depth = F.col("taken") + F.col("pos") - F.col("h")
    tails = tails.select(*row(depth, [F.col(c) for c in turn], now, before))
    return roots.unionByName(heads).unionByName(tails)


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per proposed node, with whether its members agree."""
    same = [F.min(c) == F.max(c) for c in (*_UP, "key1", "key2", "bytes")]
    agree = same[0]
    for test in same[1:]:
        agree = agree & test
    return rows.groupBy("depth", *_NODE).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        *[F.max(c).alias(c) for c in _UP],
        agree.alias("agree"),
    )


def _running(rows: DataFrame, key: str, place: str, values: list[str], block: int) -> DataFrame:
    """`rows` with, for each value, the sum over rows of the key at smaller places.

    Blocks of places are summed first, so that a key of any size is no single group.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(place) / block))
    totals = blocked.groupBy(key, "_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        key, "_block", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    joined = blocked.withColumns(before).join(totals, [key, "_block"])
    return joined.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_o_{v}") for v in values}).drop(
        "_block", *[f"_o_{v}" for v in values]
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, fp1, fp2, ends_sha256) of the numbers `conv` per node, ascending and comma-joined.

    Blocks of numbers are sorted and written as text apart; a hash has to see them in order, so one task
    streams the texts of a node, a block at a time.
    """
    keys = ["depth", *_NODE]
    blocks = ends.groupBy(*keys, F.floor(F.col("conv") / NUMBERS).alias("block")).agg(
        F.sort_array(F.collect_list("conv")).alias("convs")
    )
    texts = blocks.select(*keys, "block", F.concat_ws(",", F.transform("convs", lambda c: c.cast("string"))).alias("text"))
    ordered = texts.repartition(*keys).sortWithinPartitions(*keys, "block").select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def done(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*keys, "ends_sha256"])

        for batch in batches:
            found = []
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*keys, "text")], strict=True):
                if key == current:
                    digest.update(b"," + text.encode())
                    continue
                if current is not None:
                    found.append((*current, digest.hexdigest()))
                current, digest = key, hashlib.sha256(text.encode())
            yield done(found)
        if current is not None:
            yield done([(*current, digest.hexdigest())])

    return map_arrow(ordered, run, "depth long, fp1 long, fp2 long, ends_sha256 string")


def _ordered(conversations: DataFrame) -> DataFrame:
    narrow = written(turns(conversations), "turns")
    # Rows alike in all that orders them are interchangeable; their place parts them over the ranges.
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest"), F.col("place")]
    ordered = narrow.select("*", place.alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv", "digest", "bytes", F.spark_partition_id().alias("part"))


def proposed(conversations: DataFrame, prime: int = PRIME, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(members, nodes), written, with fingerprints under which all members of a node agree."""
    ordered = _ordered(conversations)
    for attempt in count(seed):
        own_bases = bases(attempt, prime)
        own = prefixes(ordered, own_bases, prime)
        rows = written(members(own, rebuilt(own), own_bases, prime), "members")
        nodes = written(_nodes(rows), "nodes")
        if nodes.where(~F.col("agree")).isEmpty():
            return rows, nodes


def trie(conversations: DataFrame, prime: int = PRIME, seed: int = SEED) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row per node.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Conversation c takes the first h turns of conversation c - c % 5 (none if there is no such), h being
    its number's CRC-32 modulo 9, and its own turns after its first h. Turns are ordered by `turn`, null
    first, equal ones by the SHA-256 of their role and text, so that repeated rows are repeated turns.
    Null roles and texts are empty. Rows without a conversation number take no part; other columns
    are ignored; an empty table gives no rows, not even a root. A prime below 2^31 and a seed choose the
    fingerprints, which decide on nothing: nodes whose members differ are found, and new bases tried.

    A node stands for the smallest of its members, and every conversation for a run of nodes down to its
    end, so the sum over a subtree is that of its members' runs, less what the node's own conversation has
    above it. That takes two aggregations at any depth of the trie.
    """
    rows, nodes = proposed(conversations, prime, seed)
    key = ["depth", *_NODE]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(n) for u, n in zip(_UP, _NODE, strict=True)])
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    valued = nodes.join(children, key, "left").withColumns(
        {
            "n_children": n_children,
            "leaf": (n_children == 0).cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("bytes"),
        }
    )
    valued = written(valued, "valued")

    runs = valued.groupBy("conv").agg(F.sum("leaf").alias("run_leaf"), F.sum("saved").alias("run_saved"))
    # a long conversation's prefixes meet one row; adaptive execution splits such a partition
    sums = rows.select("conv", *key).join(runs, "conv").groupBy(*key)
    sums = sums.agg(F.sum("run_leaf").alias("all_leaf"), F.sum("run_saved").alias("all_saved"))
    above = _running(valued, "conv", "depth", ["leaf", "saved"], DEPTHS)
    digests = _digests(rows.where("ends").select(*key, "conv"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(n).alias(u) for n, u in zip(_NODE, _UP, strict=True)], F.col("conv").alias("parent")
    )
    # the root's children meet one row here, likewise
    found = above.join(parents, ["depth", *_UP], "left").join(sums, key).join(digests, key, "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("all_leaf") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
