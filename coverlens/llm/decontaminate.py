"""Benchmark leaks by spaced seeds: substitution-tolerant overlaps of documents with test items.

A seed hashes the words at the set positions of a fixed mask and ignores those between, so a replaced
word at an ignored position does not hide a match. Every seed of the items is looked up in every text;
hits are joined to the items, and the words around them are compared along the same alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, slices, text_bytes, values, written

#: 1: the word counts, 0: it is ignored. Together the first four hit every stretch of 13 words of which
#: two are replaced and of 15 of which three are. The last two serve items of few words beside them.
MASKS = ("11111", "111101", "11011001", "1000011101", "111", "1101")
LONG_MASKS = 4
#: Items of fewer words get the last two masks as well.
SHORT_WORDS = 11
#: Overlaps have so many words (or all of a shorter item) of which so many in a hundred agree.
MIN_WORDS = 13
MIN_SHARE = 80
#: Seeds up to this number (28 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SEEDS = 500_000
#: Keys of leaking documents up to this number (16 bytes each) are broadcast, else joined by a shuffle.
BROADCAST_LEAKS = 1_000_000
#: Up to this number the seeds themselves (8 bytes each) go to every task, so that it reports true hits
#: only; beyond it those that pass the filter are reported, and the join parts them.
EXACT_SEEDS = 4_000_000
#: Bits of the filter of seed hashes that every task gets: 16 a seed, 16 MB at most.
FILTER_BITS = (16, 27)
_TEXT_BYTES = 2_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
#: ASCII signs do not count: only white space, letters, digits and what lies beyond ASCII.
_KEPT = np.array([b == 32 or b >= 128 or chr(b).isalnum() for b in range(256)])
_KEPT[9:14] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin and the last one's end."""
    raw = np.frombuffer(b"".join(text + b" " for text in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    kept = _KEPT[raw]
    ends = np.concatenate([[0], np.cumsum(kept)])[np.cumsum(sizes)]
    codes = _FOLD[raw[kept]]
    blank = codes == 32
    opens = ~blank & np.concatenate([[True], blank[:-1]])
    closes = blank & np.concatenate([[False], ~blank[:-1]])
    starts, stops = np.nonzero(opens)[0], np.nonzero(closes)[0]
    # Polynomial prefix sums modulo 2^64: the difference over a word, moved to where it would start
    # at 0, depends on the word alone.
    up, down = _powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = _mix((sums[stops] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, np.concatenate([[0], ends]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse modulo 2^64."""
    bases = (int(_PRIME), pow(int(_PRIME), -1, 1 << 64))
    rows = []
    for base in bases:
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        rows.append(np.multiply.accumulate(row))
    return rows[0], rows[1]


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The hash of the mask laid at every position where it fits."""
    places = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(words) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, mask + 1, np.uint64)
    for place in places:
        total = total * _PRIME + words[place : place + n]
    return _mix(total)


def longest_overlap(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch of which at least MIN_SHARE in a hundred agree: (start, end)."""
    height = np.concatenate([[0], np.cumsum(np.where(same, 100 - MIN_SHARE, -MIN_SHARE))])
    later = np.maximum.accumulate(height[::-1])[::-1]  # falls
    end = np.searchsorted(-later, -height, "right") - 1
    start = int(np.argmax(end - np.arange(len(height))))
    return start, int(end[start])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, bounds = word_hashes(values(batch.column("body")))
        rows = [words[a:b].view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.record_batch([batch.column("item_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["item_id", "item_words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["seed", "item_id", "item_at", "n_item"]
    for batch in batches:
        for item_id, raw in zip(values(batch.column("item_id")), values(batch.column("item_words")), strict=True):
            words = np.frombuffer(raw, np.uint64)
            for mask in _masks(len(words)):
                found = seeds(words, mask).view(np.int64)
                columns = [found, np.full(len(found), item_id), np.arange(len(found)), np.full(len(found), len(words))]
                yield pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _masks(n_words: int) -> list[int]:
    """The masks that serve an item: long ones of at least two places, and for few words the short ones."""
    long = [m for m in range(LONG_MASKS) if len(MASKS[m]) <= n_words - 1]
    return long + [m for m in range(LONG_MASKS, len(MASKS)) if n_words < SHORT_WORDS]


def _hits_of(bits: np.ndarray, shift: int, exact: np.ndarray | None, used: list[int], around: int):
    """Documents -> their stretches around possible hits, with the hits' seeds and places.

    bits: the filter; exact: all seeds, sorted, if there are not too many; used: the items' masks;
    around: the words of the longest item, so that whatever an item is laid along is in one stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_hash", "start", "words", "seeds", "places"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                words, bounds = word_hashes(values(batch.column("body")))
                found = []
                for mask in used:
                    own = seeds(words, mask)
                    slot = own >> np.uint64(shift)
                    at = np.nonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)[0]
                    if exact is not None:
                        near = np.searchsorted(exact, own[at])
                        at = at[exact[np.minimum(near, len(exact) - 1)] == own[at]]
                    text = np.searchsorted(bounds, at, "right") - 1
                    inside = at + len(MASKS[mask]) <= bounds[text + 1]
                    found.append((at[inside], own[at[inside]], text[inside]))
                at, seed, text = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.lexsort((at, text))
                at, seed, text = at[order], seed[order], text[order]
                apart = np.nonzero((np.diff(text) > 0) | (np.diff(at) > around))[0] + 1
                ids, hashes = values(batch.column("doc_id")), values(batch.column("row_hash"))
                rows = []
                for low, high in zip([0, *apart], [*apart, len(at)], strict=True):
                    if low == high:
                        continue
                    k = int(text[low])
                    start = max(int(bounds[k]), int(at[low]) - around)
                    end = min(int(bounds[k + 1]), int(at[high - 1]) + around)
                    part = words[start:end].tobytes()
                    rows.append((ids[k], hashes[k], start - int(bounds[k]), part, seed[low:high].view(np.int64), at[low:high] - start))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments -> the overlaps that hold."""
    names = ["doc_id", "row_hash", "item_id", "doc_start", "item_start", "n_words", "n_same"]
    for batch in batches:
        rows = []
        columns = [batch.column(c) for c in ("doc_id", "row_hash", "item_id", "start", "words", "item_words", "shift")]
        for doc_id, row_hash, item_id, start, text, item, shift in zip(*map(values, columns), strict=True):
            text, item = np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64)
            low, high = max(0, -shift), min(len(item), len(text) - shift)
            same = item[low:high] == text[low + shift : high + shift]
            begin, end = longest_overlap(same)
            if end - begin >= min(MIN_WORDS, len(item)) and end > begin:
                n_same = int(same[begin:end].sum())
                rows.append((doc_id, row_hash, item_id, start + low + shift + begin, low + begin, end - begin, n_same))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)


def _filter(found: DataFrame, n_seeds: int) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds' leading bits, and how far a seed is shifted to find its bit."""
    width = min(FILTER_BITS[1], max(13, int(n_seeds * FILTER_BITS[0]).bit_length()))
    shift = 64 - width
    slot = F.shiftrightunsigned("seed", shift)
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(slot, F.lit(8)).cast("int") + 1).alias("bit")
    words = found.select(F.shiftrightunsigned(slot, 3).alias("byte"), bit)
    bits = np.zeros(1 << (width - 3), np.uint8)
    # One row for each byte of the bitmap at most.
    for row in words.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    return bits, shift


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_same): each pair's longest overlap.

    Words are runs without white space, A-Z lower-cased, ASCII signs left out. An overlap is a stretch
    of at least 13 words (or a shorter item's length) on one alignment, of which 80 in 100 or more are
    equal; places count words from 0, ties go to the first place. Null and empty texts and items have
    no words and so no overlaps, nor do items of fewer than three words and empty tables. Repeated rows count once; rows that share an id
    are searched each, and the longest overlap is kept. Null ids stay. Other columns are ignored.
    """
    return _overlaps(docs, items).drop("row_hash").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_words", "n_same", -F.col("doc_start"), -F.col("item_start"))).alias("best")
    ).select(
        "doc_id",
        "item_id",
        (-F.col("best.col3")).alias("doc_start"),
        (-F.col("best.col4")).alias("item_start"),
        "best.n_words",
        "best.n_same",
    )


def _overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body"))
    tests = written(map_arrow(tests.distinct(), _item_words, "item_id long, item_words binary"), "items")
    tests = tests.where(F.length("item_words") > 0)
    all_seeds = map_arrow(tests, _item_seeds, "seed long, item_id long, item_at long, n_item long")
    all_seeds = written(all_seeds, "seeds")
    n_seeds = all_seeds.count()
    bits, shift = _filter(all_seeds, n_seeds)
    exact = None
    if 0 < n_seeds <= EXACT_SEEDS:
        exact = np.unique(all_seeds.select("seed").toArrow().column("seed").to_numpy().view(np.uint64))
    size = F.length("item_words") / 8
    sizes = tests.agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    # The short masks are laid only if an item has them.
    used = list(range(len(MASKS) if (sizes["least"] or SHORT_WORDS) < SHORT_WORDS else LONG_MASKS))
    around = int(sizes["most"] or 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    schema = "doc_id long, row_hash long, start long, words binary, seeds array<long>, places array<long>"
    texts = texts.withColumn("row_hash", F.xxhash64("body"))
    near = written(map_arrow(texts, _hits_of(bits, shift, exact, used, around), schema), "stretches")
    hits = near.select("doc_id", "row_hash", "start", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    hits = hits.select("doc_id", "row_hash", "start", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    joined = hits.join(F.broadcast(all_seeds) if n_seeds <= BROADCAST_SEEDS else all_seeds, "seed")
    shift_of = (F.col("place") - F.col("item_at")).alias("shift")
    aligned = joined.select("doc_id", "row_hash", "start", "item_id", "n_item", shift_of).distinct()
    places = near.select("doc_id", "row_hash", "start", "words").distinct().alias("n")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("doc_id", "row_hash", "start")]
    rows = aligned.alias("a").join(places, same[0] & same[1] & same[2])
    # Of the stretch, only what the item lies along.
    begin, before = F.greatest("shift", F.lit(0)), F.least("shift", F.lit(0))
    along = F.substring(F.col("n.words"), (begin * 8 + 1).cast("int"), ((F.col("n_item") + before) * 8).cast("int"))
    start = (F.col("a.start") + begin).alias("start")
    rows = rows.select("a.doc_id", "a.row_hash", "item_id", start, before.alias("shift"), along.alias("words"))
    rows = rows.join(tests, "item_id")
    schema = "doc_id long, row_hash long, item_id long, doc_start long, item_start long, n_words long, n_same long"
    return map_arrow(rows, _verify, schema)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without an overlap, with their columns."""
    found = written(_overlaps(docs, items).select("doc_id", "row_hash").distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= BROADCAST_LEAKS else found
    same_id = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id"))
    same_text = F.xxhash64(text_bytes("d.text")) == F.col("f.row_hash")
    return docs.alias("d").join(found.alias("f"), same_id & same_text, "left_anti")
