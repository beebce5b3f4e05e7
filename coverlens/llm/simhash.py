"""Near copies: by SimHash, through vantage-point trees over the Hamming distance, and by similarity.

A tree fitted on a bounded sample of the distinct fingerprints deals all of them out to shards: at
each node the fingerprints within `radius` of a vantage point go inward, the others outward. Two
fingerprints at most `reach` bits apart have distances to the vantage point that differ by at most
`reach` (triangle inequality), so it is enough to show the outer side a copy of the inner ones
farther than `radius - reach`: such a pair meets in at least one shard. A shard is searched the same
way, with a tree of its own, down to blocks small enough to compare.

Near copies by similarity (`similar_groups`) take the components of the fingerprints first: each one's
texts are compared in full, and those at the similarity are linked. Texts as similar may have
fingerprints farther apart, so the rest is found by an exact way: two sets of shingles with a Jaccard
similarity of t or more share one of the first n - ceil(t n) + 1 shingles of each, in any order that is
the same for all. Rare shingles come first, so that few sets meet; of those that meet, all pairs that
are not in one component by then are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coverlens.llm.common import map_arrow, ship, slices, text_bytes, values, written
from coverlens.llm.components import components

SHINGLE_WORDS = 3
REACH = 2
SEED = 42
#: Fingerprints that a shard should hold, and at most so many are fetched to fit the tree.
SHARD_ROWS = 4096
SAMPLE_ROWS = 32_768
#: For near copies by similarity: words of a shingle; of so many distinct texts one tells which shingles are
#: common (all, of few texts), at most so many of them are told apart. They decide on the order alone.
SIMILAR_WORDS = 5
ORDER_SHARE = 16
ORDER_ALL_BYTES = 32_000_000
ORDER_SHINGLES = 500_000
#: First shingles of texts that one group should hold.
PREFIX_ROWS = 500_000
#: Keys of texts to compare up to this number (24 bytes each) are broadcast, else joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: A group of texts that meet is compared with one of them at a time for so many rounds, then pair by pair.
STAR_ROUNDS = 2
#: A set's sketch tells which classes of hashes hold an odd number of its shingles: a power of two, at least
#: so many classes and so many a shingle.
SKETCH_BITS = 64
SKETCH_SHARE = 2
_BLOCK = 512
_STEP = 255 * 256
_PAIRS = 1_000_000
_TEXT_BYTES = 4_000_000
_MARKED = "doc_id long, row_hash long, fp long, node long, size long, sketch binary"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased; the separators are space and 0x09 to 0x0D."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of `size` words (of all words, if fewer); none for no words."""
    if not words:
        return np.zeros(0, ">u8")
    if len(words) <= size:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.array(list(map(xxhash.xxh64_intdigest, runs, repeat(seed))), ">u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, the highest bit first."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _STEP):
        part = hashes[start : start + _STEP]
        bits = np.unpackbits(part.view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:  # up to 255 rows fit a byte
            total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 for a text without words."""
    return _packed(shingle_hashes(words_of(text), size, seed))


def _packed(hashes: np.ndarray) -> int:
    set_bits = np.packbits(bit_counts(hashes) * 2 > len(hashes))
    return int.from_bytes(set_bits.tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long): one row per document, the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, size, seed) for text in values(batch.column("body"))]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return map_arrow(rows, run, "doc_id long, fp long")


class VantageTree:
    """Vantage points with radii; `shards` tells the shards in which each point is shown."""

    def __init__(self, points: np.ndarray, shard_rows: int, reach: int) -> None:
        self.reach = reach
        self.nodes: list[tuple[int, int, int, int]] = []
        self.n_shards = 0
        root = [0]
        todo = [(points, root, 0)]
        while todo:
            part, place, at = todo.pop()
            split = self._split(part, shard_rows)
            if split is None:
                place[at] = -1 - self.n_shards
                self.n_shards += 1
                continue
            pivot, radius, inner, outer = split
            node = [int(pivot), radius, 0, 0]
            place[at] = len(self.nodes)
            self.nodes.append(node)
            todo += [(inner, node, 2), (outer, node, 3)]
        self.root = root[0]

    def _split(self, part: np.ndarray, shard_rows: int):
        """The vantage point and radius that leave the fewest comparisons, if a quarter is saved."""
        if len(part) <= shard_rows:
            return None
        best = (0.75 * len(part) ** 2, None)
        for pivot in part[np.linspace(0, len(part) - 1, 9).astype(int)]:
            upto = np.cumsum(np.bincount(np.bitwise_count(part ^ pivot), minlength=65))
            radius = np.arange(65)
            kept = np.where(radius >= self.reach, upto[np.maximum(radius - self.reach, 0)], 0)
            work = upto.astype(float) ** 2 + (len(part) - kept).astype(float) ** 2
            if work.min() < best[0]:
                best = (work.min(), (pivot, int(work.argmin())))
        if best[1] is None:
            return None
        pivot, radius = best[1]
        inner, outer = self._sides(part, pivot, radius)
        return pivot, radius, part[inner], part[outer]

    def _sides(self, part: np.ndarray, pivot, radius: int) -> tuple[np.ndarray, np.ndarray]:
        far = np.bitwise_count(part ^ np.uint64(pivot)).astype(np.int64)
        return far <= radius, far > radius - self.reach

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of the points shown there), shards without points left out."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -1 - at, rows
                continue
            pivot, radius, inner, outer = self.nodes[at]
            near, far = self._sides(points[rows], pivot, radius)
            todo += [(inner, rows[near]), (outer, rows[far])]


def _near(points: np.ndarray, rows: np.ndarray, others: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.nonzero(np.bitwise_count(points[rows, None] ^ points[None, others]) <= reach)
    return rows[left], others[right]


def close_pairs(points: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs at most `reach` bits apart, in parts; a pair may come more than once."""
    tree = VantageTree(points, _BLOCK, reach)
    for _, rows in tree.shards(points):
        step = max(1, _PAIRS // len(rows))
        for start in range(0, len(rows), step):
            left, right = _near(points, rows[start : start + step], rows[start:], reach)
            yield left[left != right], right[left != right]


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots after more links; root[i] <= i is the least position linked with i so far."""
    a, b = root[left], root[right]
    while (differ := a != b).any():
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, high, low)
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[low], root[high]
    return root


def forest(points: np.ndarray, reach: int) -> np.ndarray:
    """The least position that each position is linked with, directly or not.

    Links are pairs at most `reach` bits apart. In a dense block points of one component are not compared
    with each other any more, so that a large group of copies costs about its size, not its square.
    """
    root = np.arange(len(points))

    def join(rows: np.ndarray, others: np.ndarray) -> None:
        nonlocal root
        left, right = _near(points, rows, others, reach)
        if len(left):
            root = _join(root, left, right)

    tree = VantageTree(points, _BLOCK, reach)
    for _, rows in tree.shards(points):
        if len(rows) <= 4 * _BLOCK:
            step = max(1, _PAIRS // len(rows))
            for start in range(0, len(rows), step):
                join(rows[start : start + step], rows[start:])
            continue
        while len(rows):
            own = root[rows] == root[rows[0]]
            if np.count_nonzero(own) < _BLOCK:
                first = rows[: max(1, _PAIRS // len(rows))]
                join(first, rows)
                rows = rows[len(first) :]
                continue
            same, rows = rows[own], rows[~own]
            step = max(1, _PAIRS // max(1, len(rows)))
            for start in range(0, len(same), step):
                apart = rows[root[rows] != root[same[0]]]
                if not len(apart):
                    break
                join(same[start : start + step], apart)
    return root


def _dealt(points: DataFrame, reach: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """`points` with a column `shard`: every row in each shard where its fingerprint `fp` is shown."""
    n = points.count()
    # At most an eighth of the fingerprints, and a bounded number, fit the tree; all are dealt out.
    share = min(0.125, sample_rows / max(n, 1))
    picked = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = np.array([r.fp for r in picked.limit(2 * sample_rows).collect()], np.int64).view(np.uint64)
    sample.sort()
    tree = VantageTree(sample, max(1, int(shard_rows * share)), reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, rows in tree.shards(own):
                shown = batch.take(pa.array(rows))
                yield shown.append_column("shard", pa.array(np.full(len(rows), shard, np.int64)))

    return map_arrow(points, run, StructType([*points.schema, StructField("shard", LongType())]))


def links(
    points: DataFrame,
    reach: int = REACH,
    every_pair: bool = False,
    shard_rows: int = SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(a long, b long) links between distinct fingerprints `fp` at most `reach` bits apart.

    By default a spanning forest of each shard's links: their components are those of all links,
    while a dense group costs no more rows than it has members. every_pair=True gives each linked
    pair once, a < b as signed numbers.
    """
    ship(points.sparkSession)

    def join(shard: pa.Table) -> pa.Table:
        own = np.sort(shard.column("fp").to_numpy())
        unsigned = own.view(np.uint64)
        if every_pair:
            parts = list(close_pairs(unsigned, reach))
            left, right = (np.concatenate([x[i] for x in parts] or [np.zeros(0, int)]) for i in (0, 1))
            left, right = np.minimum(left, right), np.maximum(left, right)
        else:
            root = forest(unsigned, reach)
            right = np.nonzero(root != np.arange(len(own)))[0]
            left = root[right]
        return pa.table({"a": own[left], "b": own[right]})

    shards = _dealt(points, reach, shard_rows, sample_rows).groupBy("shard")
    found = shards.applyInArrow(join, "a long, b long")
    return found.distinct() if every_pair else found


def _rooted(points: DataFrame, reach: int) -> DataFrame:
    """Distinct fingerprints `fp` with a column `root`, the same for all of a component."""
    joined = components(links(points.select("fp"), reach)).toDF("fp", "root")
    return points.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_copies(
    docs: DataFrame, size: int = SHINGLE_WORDS, reach: int = REACH, seed: int = SEED
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable through
    documents whose fingerprints differ in `reach` bits or fewer, the own one included. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id keep
    their place but cannot name a component; repeated rows stay. Other columns are ignored. An empty
    table gives no rows.
    """
    marked = written(fingerprints(docs, size, seed), "fingerprints")
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    rooted = _rooted(points, reach)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    # One row per fingerprint meets its documents: a fingerprint with many is split by adaptive execution.
    return marked.join(placed, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component_id"),
    )


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted."""
    return np.unique(shingle_hashes(words_of(text), SIMILAR_WORDS, SEED).astype(np.uint64))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def sketch(shingles: np.ndarray) -> bytes:
    """Two sets' sketches differ in no more bits than shingles are in one set only.

    The two halves of a sketch give that of half the size, bit by bit: where they differ.
    """
    bits = max(SKETCH_BITS, 1 << (SKETCH_SHARE * len(shingles) - 1).bit_length()) if len(shingles) else SKETCH_BITS
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> fingerprint, hash of the five-word shingles, their number and sketch; those with the same ones are one node."""
    for whole in batches:
        for batch in slices(whole, "body", _TEXT_BYTES):
            texts = values(batch.column("body"))
            points = [fingerprint(text) for text in texts]
            rows = [(_node(s), len(s), sketch(s)) for s in map(shingle_set, texts)]
            nodes, sizes, sketches = zip(*rows, strict=True)
            long = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (points, nodes)]
            arrays = [*long, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            names = ["doc_id", "row_hash", "fp", "node", "size", "sketch"]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), *arrays], names)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in values(batch.column("body")):
            yield pa.record_batch([pa.array(shingle_set(text).view(np.int64))], ["shingle"])


def _common(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts have, sorted, and in how many of the texts looked at they are."""
    share = 1 if total <= ORDER_ALL_BYTES else ORDER_SHARE
    some = texts.where(F.pmod("row_hash", F.lit(share)) == 0)
    counts = map_arrow(some.select("body"), _shingles, "shingle long").groupBy("shingle").count()
    counts = counts.where("count > 2").orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).toArrow()
    shingles, counts = (counts.column(c).to_numpy() for c in ("shingle", "count"))
    shingles = shingles.view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def prefixes(sets: list[np.ndarray], common: np.ndarray, counts: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of its set): the first shingles of each set, rare ones and small hashes first.

    Of sets whose similarity is reached, each has one of the other's first shingles among its own.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    if len(common) and len(flat):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        seen = np.where(common[at] == flat, counts[at], 0)
        flat = flat[np.lexsort((flat, seen, owner))]
    top, bottom = similarity.numerator, similarity.denominator
    first = sizes - -(-sizes * top // bottom) + 1
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
    kept = place < first[owner]
    return flat[kept], owner[kept]


def _dealt_prefixes(common: np.ndarray, counts: np.ndarray, similarity: Fraction, parts: int):
    """Texts -> their first shingles and nodes, packed, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "body", _TEXT_BYTES):
                sets = {_node(s): s for s in map(shingle_set, values(some.column("body")))}
                shingles, owner = prefixes(list(sets.values()), common, counts, similarity)
                nodes = np.array(list(sets), np.uint64)[owner]
                part = (shingles % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                shingles, nodes, part = shingles[order], nodes[order], part[order]
                starts = np.nonzero(np.diff(part, prepend=-1))[0]
                cuts = list(zip(starts, [*starts[1:], len(part)], strict=True)) if len(part) else []
                packed = [[x[i:j].tobytes() for i, j in cuts] for x in (shingles, nodes)]
                arrays = [pa.array(part[starts]), *(pa.array(p, pa.binary()) for p in packed)]
                yield pa.record_batch(arrays, ["part", "shingles", "nodes"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _meetings(part: pa.Table) -> pa.Table:
    """The sets of nodes that share a first shingle, each once: (meeting, node)."""
    shingles, nodes = (np.frombuffer(b"".join(values(part.column(c))), np.uint64) for c in ("shingles", "nodes"))
    order = np.lexsort((nodes, shingles))
    shingles, nodes = shingles[order], nodes[order]
    new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (nodes[1:] != nodes[:-1])])
    shingles, nodes = shingles[new], nodes[new]
    starts = np.nonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))[0]
    sizes = np.diff(starts, append=len(shingles))
    meeting = _mix(np.add.reduceat(_mix(nodes), starts) + sizes.astype(np.uint64))
    several = np.nonzero(sizes > 1)[0]
    several = several[np.unique(meeting[several], return_index=True)[1]]
    kept = np.isin(np.repeat(np.arange(len(starts)), sizes), several)
    arrays = [np.repeat(meeting, sizes)[kept], nodes[kept]]
    return pa.table([pa.array(x.view(np.int64)) for x in arrays], ["meeting", "node"])


def sketch_distances(ones: list[bytes], twos: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of each pair differ, the longer one folded to the length of the other."""
    sizes = np.array([list(map(len, ones)), list(map(len, twos))], np.int64).reshape(2, -1)
    out = np.zeros(len(ones), np.int64)
    for kind in np.unique(sizes, axis=1).T:
        rows = np.nonzero((sizes == kind[:, None]).all(0))[0]
        ends = []
        for side, size in zip((ones, twos), kind, strict=True):
            end = np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(-1, size // 8)
            while end.shape[1] * 8 > kind.min():
                half = end.shape[1] // 2
                end = end[:, :half] ^ end[:, half:]
            ends.append(end)
        out[rows] = np.bitwise_count(ends[0] ^ ends[1]).sum(1, dtype=np.int64)
    return out


def _may_be_alike(similarity: Fraction):
    """Pairs of sketches -> those that may have the similarity: no pair that has it is left out."""
    top, bottom = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = sketch_distances(*(values(batch.column(c)) for c in ("sketch_a", "sketch_b")))
            both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((both - far) * bottom >= (both + far) * top))

    return run


def _alike(similarity: Fraction):
    """Pairs of texts -> those whose sets of shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body_a", _TEXT_BYTES):
                sets: dict[int, np.ndarray] = {}
                kept = []
                ends = [values(batch.column(c)) for c in ("a", "b")]
                texts = [batch.column(c) for c in ("body_a", "body_b")]
                for row, pair in enumerate(zip(*ends, strict=True)):
                    for node, column in zip(pair, texts, strict=True):
                        if node not in sets:
                            sets[node] = shingle_set(column[row].as_py())
                    one, two = (sets[node] for node in pair)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    kept.append(both * similarity.denominator >= (len(one) + len(two) - both) * similarity.numerator)
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _bodies(nodes: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, body): one text of each node."""
    own = marked.select("doc_id", "row_hash", "node").join(nodes, "node", "left_semi")
    heads = own.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("head"))
    heads = written(heads.select("node", "head.*"), "heads")
    heads = (F.broadcast(heads) if heads.count() <= BROADCAST_TEXTS else heads).alias("h")
    same = (F.col("t.row_hash") == F.col("h.row_hash")) & F.col("t.doc_id").eqNullSafe(F.col("h.doc_id"))
    return texts.alias("t").join(heads, same).select("node", "body").dropDuplicates(["node"])


def _ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of `table` for both nodes, as name_a and name_b."""
    for end in ("a", "b"):
        own = [F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in table.columns]
        pairs = pairs.join(table.select(*own), end)
    return pairs


def fingerprint_meetings(marked: DataFrame, reach: int = REACH) -> DataFrame:
    """(meeting, node, size): the nodes whose fingerprints are in one component, where there are several."""
    points = written(marked.select("fp").distinct(), "points")
    rooted = _rooted(points, reach).select("fp", F.col("root").alias("meeting"))
    # One row per fingerprint meets its nodes: a fingerprint with many is split by adaptive execution.
    nodes = marked.select("fp", "node", "size").distinct()
    meetings = written(nodes.join(rooted, "fp").select("meeting", "node", "size").distinct(), "meetings")
    several = meetings.groupBy("meeting").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return meetings.join(several.where("low < high").select("meeting"), "meeting", "left_semi")


def prefix_meetings(texts: DataFrame, marked: DataFrame, similarity: Fraction) -> DataFrame:
    """(meeting, node, size): the nodes that share a first shingle, so that all pairs at the similarity meet."""
    total = texts.agg(F.sum(F.length("body"))).first()[0] or 0
    # A word has some six bytes; of so many shingles that share comes first.
    parts = max(24, int(total / 6 * (1 - similarity) / PREFIX_ROWS))
    run = _dealt_prefixes(*_common(texts, total), similarity, parts)
    dealt = map_arrow(texts.select("body"), run, "part long, shingles binary, nodes binary")
    meetings = dealt.groupBy("part").applyInArrow(_meetings, "meeting long, node long").distinct()
    return meetings.join(marked.select("node", "size").distinct(), "node").select("meeting", "node", "size")


def _similar_links(first: DataFrame, meetings: DataFrame, marked: DataFrame, texts: DataFrame, similarity: Fraction) -> DataFrame:
    """(node, root) of the components of all pairs that meet and have the similarity.

    Pairs that are in one component already are not compared. So members of the meetings of `first` are
    compared with one of them only, and members of the others as well in each of a few rounds; that
    leaves few pairs, even of a large group of copies, which are compared each.
    """
    top, bottom = F.lit(similarity.numerator), F.lit(similarity.denominator)
    sketches = marked.select("node", "size", "sketch").dropDuplicates(["node"])
    found = joined = None
    for turn in range(STAR_ROUNDS + 2):
        rooted = (meetings if turn else first).withColumn("root", F.col("node"))
        if joined is not None:
            rooted = meetings.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = rooted.groupBy("meeting").agg(F.min("root").alias("low"), F.max("root").alias("high"))
            rooted = rooted.join(apart.where("low < high").select("meeting"), "meeting", "left_semi")
            rooted = written(rooted.select("meeting", "node", "size", "root"), "meetings")
            if not rooted.limit(1).count():
                break
        if turn <= STAR_ROUNDS:
            head = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "size", "root")).alias("head")
            others = rooted.groupBy("meeting").agg(head).select("meeting", "head.*")
            apart = "root <> its"
        else:
            others, apart = rooted, "root < its"
        others = others.select("meeting", *(F.col(c).alias(n) for c, n in (("node", "other"), ("size", "length"), ("root", "its"))))
        # One row per meeting meets its members: adaptive execution splits a large one.
        pairs = rooted.join(others, "meeting").where(apart)
        # The shorter set has at most all of its shingles in the other one.
        pairs = pairs.where(F.least("size", "length") * bottom >= F.greatest("size", "length") * top)
        ends = F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
        pairs = _ends(pairs.select(*ends).distinct(), sketches)
        near = written(map_arrow(pairs, _may_be_alike(similarity), "a long, b long"), "near")
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        pairs = _ends(near, _bodies(nodes, marked, texts))
        alike = written(map_arrow(pairs, _alike(similarity), "a long, b long"), "alike")
        found = alike if found is None else found.union(alike)
        joined = components(found)
    return joined


def similar_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_hash, group): rows that share a group are near copies, directly or not.

    Near copies: texts whose sets of five-word shingles have a similarity (Jaccard) of `similarity` or
    more; all such pairs count, and no others. Candidates come from SimHash fingerprints, the pairs that
    these miss from shared first shingles. Texts of fewer than five words are one shingle; texts
    without words are copies of each other. row_hash tells rows that share an id apart.
    """
    least = Fraction(similarity).limit_denominator(1000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    texts = texts.withColumn("row_hash", F.xxhash64("body"))
    marked = written(map_arrow(texts, _marked, _MARKED), "marked")
    first = fingerprint_meetings(marked)
    meetings = written(prefix_meetings(texts, marked, least), "meetings")
    found = _similar_links(first, meetings, marked, texts, least)
    # Texts without a near copy have no row here; a hot node is split by adaptive execution.
    rooted = marked.join(found, "node", "left")
    return rooted.select("doc_id", "row_hash", F.coalesce("root", "node").alias("group"))


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of `docs` for each group of near copies, that of the smallest doc_id; columns stay.

    A null doc_id is the smallest; rows that share an id are told apart by their texts, and of equal
    rows one stays. All other rows stay. Columns may have any names.
    """
    groups = similar_groups(docs, similarity)
    heads = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row_hash")).alias("head"))
    heads = written(heads.select("head.*"), "heads")
    # the row is carried as one column, so that no name of its own can meet one added here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_bytes()).alias("hash"), row)
    same = F.col("d.id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.hash") == F.col("h.row_hash"))
    kept = rows.alias("d").join(heads.alias("h"), same, "left_semi")
    one = Window.partitionBy("id", "hash").orderBy("id")
    kept = kept.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
