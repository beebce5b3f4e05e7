"""Join of documents on the Jaccard similarity of their word n-grams, over R-trees of count vectors.

Tokens are hashes of n-grams. Hashed into groups, a set becomes a vector of counts, and the summed minima
of two vectors' coordinates bound the overlap of their sets from above; so do the summed minima of two
boxes' upper corners for all sets in them. An R-tree over such vectors thus rules out most pairs; the rest
are counted exactly on the hashes.

Which sets may meet in a tree follows from the counts as well. Sets that reach the similarity differ in
at most D tokens, so of more than D bands of groups at least one has equal counts in both. Every set is
dealt to one place per band, named by what the band holds; sets of one place, directly or over others,
are one unit of work, and a large unit is cut into parts that are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, slices, text_bytes, values, written
from coverlens.llm.components import components

WORDS = 3
PERCENT = 90
SEED = 1
#: The longest set of a range of sizes is so many times as large as the shortest.
RANGE = 1.5
#: Tokens that a part of a unit should hold.
PART_TOKENS = 2_000_000
#: Up to so many documents to compare (8 bytes each) are picked by a broadcast, more by a shuffle.
BROADCAST_DOCS = 1_000_000
LEAF_ROWS = 32
_SEEN = 1 << 20
_TEXT_BYTES = 16_000_000
_COLUMNS = 1 << 15
# Odd multipliers of the 64-bit finaliser of the MurmurHash family, and of the words' places.
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_PLACE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ x >> np.uint64(33)
    for factor in _MIX:
        x = x * np.uint64(factor)
        x = x ^ x >> np.uint64(33)
    return x


def tokens(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The set of a text's n-grams as hashes, ascending; fewer words are one n-gram, none are none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return _mixed(np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64) + np.uint64(len(found)))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, found, repeat(seed))), np.uint64)
    n = len(hashes) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += hashes[i : i + n] * np.uint64(pow(_PLACE, i + 1, 1 << 64))
    return np.unique(_mixed(total))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_ids(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set; (0, 0) for the empty one."""
    return tuple(_signed(int(_mixed(own + np.uint64(i * 2 + 1)).sum(dtype=np.uint64))) for i in (0, 1))


@cache
def size_ranges(upto: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(least, greatest, bands, slack) of each range of sizes that reaches down to `upto`.

    A linked pair whose smaller set has s tokens differs in at most s (100 - percent) / percent of them,
    and lies whole in the range that starts at or below s. Beyond one band more than that, `slack`
    bands are laid so that a set may have so many empty ones and still share one that is not.
    """
    spare = 100 - percent
    least = -(-percent // spare) if spare else upto + 1
    out = []
    while least <= upto:
        following = max(least + 1, int(least * RANGE))
        apart = (following - 1) * spare // percent
        slack = 1 + apart // 16
        out.append((least, (following - 1) * 100 // percent, apart + 1 + slack, slack))
        least = following
    return out


def places(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Names of the places that a set is dealt to: what each band of each range of its size holds."""
    out = []
    mixed = _mixed(own + np.uint64(7))
    for number, (least, greatest, bands, slack) in enumerate(size_ranges(len(own), percent)):
        if not least <= len(own) <= greatest:
            continue
        band = (own >> np.uint64(32)) * np.uint64(bands) >> np.uint64(32)
        start = np.nonzero(np.concatenate([[True], band[1:] != band[:-1]]))[0]
        held, total = band[start], np.add.reduceat(mixed, start)
        if bands - len(held) > slack:  # too many empty bands to do without them
            empty = np.setdiff1d(np.arange(bands, dtype=np.uint64), held)
            held, total = np.concatenate([held, empty]), np.concatenate([total, np.zeros(len(empty), np.uint64)])
        out.append(_mixed(total + held * np.uint64(_PLACE) + np.uint64(number * _MIX[0] % (1 << 64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def described(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n, a, b, places): a document's set, by two names; its places once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                sizes, first, second, dealt = [], [], [], []
                for text in values(batch.column("body")):
                    own = tokens(text, words, seed)
                    a, b = set_ids(own)
                    known = a in seen
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(a)
                    sizes.append(len(own))
                    first.append(a)
                    second.append(b)
                    dealt.append(None if known else places(own, percent).view(np.int64))
                columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, first, second))]
                columns.append(pa.array(dealt, pa.list_(pa.int64())))
                yield pa.record_batch(columns, ["doc_id", "n", "a", "b", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return map_arrow(rows, run, "doc_id long, n long, a long, b long, places array<long>")


def _meetings(marked: DataFrame) -> DataFrame:
    """(a, b) links from each set of a place to the place's first set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place, own = (batch.column(c).to_numpy() for c in ("place", "a"))
            opens = np.concatenate([[True], place[1:] != place[:-1]])
            first = own[np.maximum.accumulate(np.where(opens, np.arange(len(own)), 0))]
            if last is not None and place[0] == last:
                first[place == last] = hub
            last, hub = place[-1], first[-1]
            met = own != first
            yield pa.record_batch([pa.array(own[met]), pa.array(first[met])], ["a", "b"])

    dealt = marked.select(F.explode("places").alias("place"), "a")
    dealt = dealt.repartition("place").sortWithinPartitions("place", "a")
    return map_arrow(dealt, run, "a long, b long")


class CountTree:
    """An R-tree over count vectors, packed by halving at the median of the widest coordinate."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.sizes = counts.sum(1)
        self.order = np.arange(len(counts))
        #: (start, end, children, upper corner, least size, greatest size)
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(counts))

    def _build(self, start: int, end: int) -> int:
        rows = self.order[start:end]
        own = self.counts[rows]
        high = own.max(0)
        children = ()
        if len(rows) > LEAF_ROWS:
            spread = np.append(high - own.min(0), self.sizes[rows].max() - self.sizes[rows].min())
            widest = int(spread.argmax())
            key = self.sizes[rows] if widest == own.shape[1] else own[:, widest]
            self.order[start:end] = rows[np.argsort(key, kind="stable")]
            middle = (start + end) // 2
            children = (self._build(start, middle), self._build(middle, end))
        sizes = self.sizes[rows]
        self.nodes.append((start, end, children, high, int(sizes.min()), int(sizes.max())))
        return len(self.nodes) - 1


def _may_link(left: tuple, right: tuple, percent: int) -> bool:
    """Whether the boxes of two nodes leave room for a linked pair."""
    if 100 * left[5] < percent * right[4] or 100 * right[5] < percent * left[4]:
        return False
    bound = int(np.minimum(left[3], right[3]).sum())
    return (100 + percent) * bound >= percent * (left[4] + right[4])


def near_leaves(left: CountTree, right: CountTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of leaves that may hold a linked pair; within one tree each pair once."""
    same = left is right
    todo = [(left.root, right.root)]
    while todo:
        i, j = todo.pop()
        one, two = left.nodes[i], right.nodes[j]
        if not _may_link(one, two, percent):
            continue
        if not one[2] and not two[2]:
            yield left.order[one[0] : one[1]], right.order[two[0] : two[1]]
        elif same and i == j:
            a, b = one[2]
            todo += [(a, a), (a, b), (b, b)]
        elif one[2] and (not two[2] or one[1] - one[0] >= two[1] - two[0]):
            todo += [(child, j) for child in one[2]]
        else:
            todo += [(i, child) for child in two[2]]


def _in_common(left: list[np.ndarray], right: list[np.ndarray], ask: np.ndarray) -> np.ndarray:
    """How many tokens the sets asked for have in common (at least), as a matrix."""
    found = np.zeros(ask.shape, np.int64)
    if ask.sum() <= 2 * max(ask.shape):
        for i, j in zip(*np.nonzero(ask), strict=True):
            at = np.searchsorted(left[i], right[j])
            at[at == len(left[i])] = 0
            found[i, j] = np.count_nonzero(left[i][at] == right[j])
        return found
    every = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for start in range(0, len(every), _COLUMNS):
        part = every[start : start + _COLUMNS]
        sides = []
        for sets in (left, right):
            held = np.zeros((len(sets), len(part)), np.float32)
            for row, own in zip(held, sets, strict=True):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                at = np.searchsorted(part, own)
                row[at[part[at] == own]] = 1
            sides.append(held)
        found += (sides[0] @ sides[1].T).astype(np.int64)  # sums below 2^15 are exact
    return found


def _counts(sets: list[np.ndarray], groups: int) -> np.ndarray:
    out = np.zeros((len(sets), groups), np.int32)
    for row, own in zip(out, sets, strict=True):
        row += np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple]:
    """(rows, rows, tokens in common) of all linked pairs of two lists of sets, or within one (right=None)."""
    both = left + (right or [])
    mean = sum(map(len, both)) / len(both)
    groups = 1 << int(np.clip(np.round(np.log2(max(1.0, mean / 2))), 4, 9))
    one = CountTree(_counts(left, groups))
    two, right = (one, left) if right is None else (CountTree(_counts(right, groups)), right)
    for a, b in near_leaves(one, two, percent):
        bound = np.minimum(one.counts[a][:, None], two.counts[b][None]).sum(2, dtype=np.int64)
        sizes = one.sizes[a][:, None] + two.sizes[b][None]
        ask = (100 + percent) * bound >= percent * sizes
        if one is two and a[0] == b[0]:  # a leaf with itself
            ask &= np.triu(np.ones(ask.shape, bool), 1)
        if not ask.any():
            continue
        common = _in_common([left[i] for i in a], [right[j] for j in b], ask)
        x, y = np.nonzero(ask & (100 * common >= percent * (sizes - common)))
        if len(x):
            yield a[x], b[y], common[x, y]


class _Unit:
    """The sets of one unit of work, or of two parts of one."""

    def __init__(self) -> None:
        self.rows: dict[int, tuple[int, int, np.ndarray]] = {}

    def add(self, a: int, side: int, copies: int, own: bytes) -> None:
        if a not in self.rows:
            self.rows[a] = (side, copies, np.frombuffer(own, np.uint64))

    def pairs(self, cross: bool, percent: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
        sides = [[a for a, (side, _, _) in self.rows.items() if side == s] for s in (0, 1)]
        if not sides[0] or (cross and not sides[1]):
            return
        names = [np.array(s, np.int64) for s in sides]
        sets = [[self.rows[a][2] for a in s] for s in sides]
        for x, y, common in linked_pairs(sets[0], sets[1] if cross else None, percent):
            yield names[0][x], names[int(cross)][y], common


def _root(of: dict[int, int], a: int) -> int:
    while (up := of.get(a, a)) != a:
        of[a] = of.get(up, up)
        a = up
    return a


def _compare(percent: int, every_pair: bool):
    """Units in order -> their linked pairs, or for each linked set a link of their forest and its partners."""

    def result(unit: _Unit, cross: bool) -> Iterator[pa.RecordBatch]:
        of: dict[int, int] = {}
        partners: dict[int, int] = {}
        for left, right, common in unit.pairs(cross, percent):
            if every_pair:
                columns = [pa.array(c, pa.int64()) for c in (np.minimum(left, right), np.maximum(left, right), common)]
                yield pa.record_batch(columns, ["a", "b", "overlap"])
                continue
            for a, b in zip(left.tolist(), right.tolist(), strict=True):
                partners[a] = partners.get(a, 0) + unit.rows[b][1]
                partners[b] = partners.get(b, 0) + unit.rows[a][1]
                x, y = _root(of, a), _root(of, b)
                if x != y:
                    of[max(x, y)] = min(x, y)
        if partners:
            columns = [list(partners), [_root(of, a) for a in partners], list(partners.values())]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, unit = None, _Unit()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "low", "high", "a", "part", "copies", "own")]
            for *key, a, part, copies, own in zip(*columns, strict=True):
                if key != current:
                    if current is not None:
                        yield from result(unit, current[1] != current[2])
                    current, unit = key, _Unit()
                unit.add(a, int(part != key[1]), copies, own)
        if current is not None:
            yield from result(unit, current[1] != current[2])

    return run


def _own_tokens(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                own = [tokens(text, words, seed) for text in values(batch.column("body"))]
                columns = [pa.array([set_ids(x)[0] for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
                yield pa.record_batch(columns, ["a", "own"])

    return run


def _sets(docs: DataFrame, words: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """`described` documents, the distinct sets, and the seed under which their names tell them apart."""
    for own_seed in count(seed):
        marked = written(described(docs, words, percent, own_seed), "described")
        sets = marked.groupBy("a").agg(
            F.max("n").alias("n"),
            F.min("doc_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            (F.min("b") == F.max("b")).alias("one"),
        )
        sets = written(sets, "sets")
        if sets.where(~F.col("one")).isEmpty():
            return marked, sets.drop("one"), own_seed


def _compared(
    docs: DataFrame, marked: DataFrame, sets: DataFrame, words: int, percent: int, seed: int, every_pair: bool,
    part_tokens: int, broadcast_docs: int,
) -> DataFrame:
    met = components(_meetings(marked.where("places IS NOT NULL")))
    roots = met.select(F.col("root").alias("a"), F.col("root").alias("unit")).distinct()
    units = met.select(F.col("node").alias("a"), F.col("root").alias("unit")).union(roots)
    members = written(units.join(sets, "a"), "units")
    parts = members.groupBy("unit").agg(F.ceil(F.sum("n") / part_tokens).cast("int").alias("parts"))

    # One document stands for a set; those without a number are looked through as a whole.
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    wanted = members.where("least IS NOT NULL").select(F.col("least").alias("doc_id")).distinct()
    if wanted.count() <= broadcast_docs:
        wanted = F.broadcast(wanted)
    texts = body.join(wanted, "doc_id", "left_semi").select("body")
    if not members.where("least IS NULL").isEmpty():
        texts = texts.union(body.where("doc_id IS NULL").select("body"))
    held = map_arrow(texts, _own_tokens(words, seed), "a long, own binary")

    rows = held.join(members.join(parts, "unit").select("a", "unit", "parts", "copies"), "a")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["unit", "low", "high"]
    rows = rows.select(
        "unit", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "a", "part", "copies", "own"
    )
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    return map_arrow(rows, _compare(percent, every_pair), f"a long, b long, {'overlap' if every_pair else 'partners'} long")


def pairs(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = SEED,
    part_tokens: int = PART_TOKENS, broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """(doc_a, doc_b, overlap, n_union): every linked pair of different sets, each set by its smallest doc_id.

    `join` tells the set of every document, and what nulls, empty texts and repeated rows give.
    """
    marked, sets, own_seed = _sets(docs, words, percent, seed)
    found = _compared(docs, marked, sets, words, percent, own_seed, True, part_tokens, broadcast_docs)
    names = sets.select("a", F.col("least"), F.col("n"))
    for side, other in (("a", "doc_a"), ("b", "doc_b")):
        found = found.join(names.toDF(side, other, f"n_{side}"), side)
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return found.select(
        F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "overlap", union.alias("n_union")
    )


def join(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = SEED,
    part_tokens: int = PART_TOKENS, broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row per row of `docs`.

    Two documents link when the n-grams in common are at least `percent` in 100 of those in either;
    n_links counts the documents linked with one, equal sets among them, and component_id is the
    smallest doc_id reachable. A text with fewer words is one n-gram; a null text, or one without words, has
    an empty set, links with nothing and is its own component. Rows with a null doc_id keep their place but
    cannot name a component; repeated rows are documents of their own, though one without words keeps
    its own doc_id as component. Other columns are ignored; an empty table gives no rows.
    """
    marked, sets, own_seed = _sets(docs, words, percent, seed)
    compared = _compared(docs, marked, sets, words, percent, own_seed, False, part_tokens, broadcast_docs)
    compared = written(compared, "links")
    linked = components(compared.select("a", "b"))
    roots = linked.select(F.col("root").alias("a"), "root").distinct()
    linked = linked.select(F.col("node").alias("a"), "root").union(roots)
    classes = linked.join(sets.select("a", "least"), "a")
    least = classes.groupBy("root").agg(F.min("least").alias("class"))
    classes = classes.join(least, "root").select("a", "class")
    partners = compared.groupBy("a").agg(F.sum("partners").alias("partners"))
    about = sets.join(classes, "a", "left").join(partners, "a", "left").select(
        "a",
        F.coalesce("class", "least").alias("class"),
        (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    # copies of one set meet one row; adaptive execution splits such a partition
    empty = F.col("n") == 0
    return marked.drop("places").join(about, "a").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class")).alias("component_id"),
        F.when(empty, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
    )
