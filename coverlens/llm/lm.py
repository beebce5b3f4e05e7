"""Language-model scores: word counts as the base, and a causal self-attention model on subword ids.

Texts are tokenized once and kept in the shared folder as chunks: a dictionary of the chunk's words,
with their subword ids and training counts, and the texts as places in it. From the chunks come, by
Spark aggregation over all training texts, the counts of words, of subword ids and of pairs of
classes. Classes are the most frequent ids, one each, and bins of the others: the attention model
predicts the class, and the id's share of its class's count does the rest.

The attention weights are trained where the data are: every partition trains a copy on its windows, and
the copies are averaged after each round. Every window of every training text is trained on, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm import attention
from coverlens.llm.common import give_back, map_arrow, ship, slices, text_bytes, values, written
from coverlens.llm.tokens import ChunkTokenizer, split_words

HOLD_OUT = (7, 2)
#: Text bytes of a chunk, beyond one text.
CHUNK_BYTES = 4_000_000
#: Bins for the ids that are too rare to be a class of their own.
BINS = 16
OWN_CLASSES = attention.GROUP**2 - BINS
#: Weight of the classes' own shares in their shares after another class, in tokens.
PRIOR = 8
#: The learning rate of each round; a round trains on every so many-th window as there are rounds, and
#: all rounds together on every window.
RATES = (0.02, 0.008)
#: The end of a text is a word with this key, at place 0 of every dictionary.
END_KEY = 0

#: Entries of the chunks' dictionaries that one task should count.
BUCKET_ENTRIES = 500_000

_CHUNK = (
    "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, keys array<long>, "
    "train array<long>, words binary, wide boolean, lengths binary, ids binary, vocabulary long"
)


def _kind_of_id(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 65_536 else "<u4"


def _chunk(number: int, doc_ids: list, held: list[bool], texts: pa.Array, tokenizer: str) -> pa.RecordBatch:
    sizes, places, names = split_words(texts)
    sizes = (sizes + 1).astype(np.int32)
    used = np.zeros(int(sizes.sum()), np.int32)
    is_word = np.ones(len(used), bool)
    is_word[np.cumsum(sizes) - 1] = False
    used[is_word] = places + 1  # the end of a text is word 0
    own = ChunkTokenizer.of(tokenizer)
    known = own.learn(names)
    # the end of a text is an id of its own, behind the tokenizer's
    raw = [np.array([own.size], "<u4").tobytes(), *map(known.__getitem__, names)]
    training = np.repeat(~np.array(held, bool), sizes)
    train = np.bincount(used[training], minlength=len(raw))
    keys = [END_KEY, *map(xxhash.xxh64_intdigest, names)]
    wide = len(raw) > 65_536
    row = {
        "chunk": (number, pa.int64()),
        "doc_ids": (doc_ids, pa.list_(pa.int64())),
        "held": (held, pa.list_(pa.bool_())),
        "sizes": (sizes, pa.list_(pa.int32())),
        "keys": (np.array(keys, np.uint64).view(np.int64), pa.list_(pa.int64())),
        "train": (train, pa.list_(pa.int64())),
        "words": (used.astype(np.int32 if wide else np.uint16).tobytes(), pa.binary()),
        "wide": (wide, pa.bool_()),
        "lengths": (np.array([len(r) // 4 for r in raw], np.int32).tobytes(), pa.binary()),
        "ids": (np.frombuffer(b"".join(raw), "<u4").astype(_kind_of_id(own.size + 1)).tobytes(), pa.binary()),
        "vocabulary": (own.size + 1, pa.int64()),
    }
    return pa.record_batch([pa.array([v], k) for v, k in row.values()], list(row))


def chunks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All texts as chunks; `held` marks those that nothing is learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "body", CHUNK_BYTES):
                doc_ids, held = (values(batch.column(c)) for c in ("doc_id", "held_out"))
                yield _chunk(number, doc_ids, held, batch.column("body"), tokenizer)
                number += 1

    divisor, remainder = HOLD_OUT
    key = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))
    held = F.coalesce(key == remainder, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_bytes().alias("body"))
    return written(map_arrow(rows, run, _CHUNK), "chunks", group_rows=1)


def _deal(n_buckets: int):
    """Chunks -> their dictionaries in packed parts, by the buckets of the words' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            keys, train = np.array(row["keys"], np.int64), np.array(row["train"], np.int64)
            bucket = keys.view(np.uint64) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            columns = [
                pa.array(used.astype(np.int64)),
                pa.array(np.full(len(used), row["chunk"])),
                pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                pa.array([train[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
            ]
            yield pa.record_batch(columns, ["bucket", "chunk", "keys", "train"])

    return run


def _count_bucket(bucket: pa.Table) -> pa.Table:
    """The counts over all chunks of a bucket's words, packed for each chunk as they came.

    distinct and total, of the words that occur in training texts, stand in the first row.
    """
    raw = values(bucket.column("keys"))
    keys = np.frombuffer(b"".join(raw), np.int64)
    train = np.frombuffer(b"".join(values(bucket.column("train"))), np.int32)
    _, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, train).astype(np.int64)
    ends = np.cumsum([len(r) // 8 for r in raw])[:-1]
    rest = [0] * (len(raw) - 1)
    return pa.table(
        {
            "chunk": bucket.column("chunk"),
            "bucket": bucket.column("bucket"),
            "counts": pa.array([c.tobytes() for c in np.split(counts[place], ends)], pa.binary()),
            "distinct": [int((counts > 0).sum()), *rest],
            "total": [int(counts.sum()), *rest],
        }
    )


def word_counts(parts: DataFrame, n_buckets: int) -> DataFrame:
    """(chunk, bucket, counts, distinct, total): how often the words of each chunk occur in training texts.

    A bucket has a row for each chunk, and no word more entries than there are chunks.
    """
    ship(parts.sparkSession)
    schema = "bucket long, chunk long, keys binary, train binary"
    dealt = map_arrow(parts.select("chunk", "keys", "train"), _deal(n_buckets), schema).groupBy("bucket")
    schema = "chunk long, bucket long, counts binary, distinct long, total long"
    return written(dealt.applyInArrow(_count_bucket, schema), "counts")


class _Texts:
    """The subword ids of a chunk's texts."""

    def __init__(self, row: dict) -> None:
        self.held = np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = np.frombuffer(row["words"], np.int32 if row["wide"] else np.uint16)
        lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[self.words]
        begin = np.cumsum(per_word) - per_word
        place = np.arange(int(per_word.sum())) + np.repeat(starts[self.words] - begin, per_word)
        self.ids = np.frombuffer(row["ids"], _kind_of_id(row["vocabulary"]))[place]
        first = np.cumsum(self.sizes) - self.sizes
        self.id_sizes = np.add.reduceat(per_word, first) if len(first) else np.zeros(0, np.int64)

    def training(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and sizes of the training texts."""
        return tokens[np.repeat(~self.held, self.id_sizes)], self.id_sizes[~self.held]


def _plain(value: pa.Scalar):
    """A value of a row; lists of integers without nulls as arrays."""
    whole = isinstance(value, pa.ListScalar) and pa.types.is_integer(value.type.value_type)
    return value.values.to_numpy() if whole and not value.values.null_count else value.as_py()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of chunks. All texts are in ids by then, so that workers need no tokenizer any more."""
    ChunkTokenizer.forget()
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: _plain(batch.column(name)[i]) for name in batch.schema.names}


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for row in _each(batches):
        size = row["vocabulary"]
        total = total if len(total) else np.zeros(size, np.int64)
        weight = np.repeat(np.array(row["train"], np.int64), np.frombuffer(row["lengths"], np.int32))
        total += np.bincount(np.frombuffer(row["ids"], _kind_of_id(size)), weight, size).astype(np.int64)
    used = np.nonzero(total)[0]
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])


@dataclass
class Vocabulary:
    """Which class an id belongs to, and the natural log of its share of the class's count."""

    class_of: np.ndarray
    share: np.ndarray
    n_classes: int


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """The most frequent ids each by itself, the others in bins of about equal counts.

    Every id is counted once more than it occurs.
    """
    counts = counts + 1
    order = np.lexsort((np.arange(len(counts)), -counts))
    class_of = np.zeros(len(counts), np.int32)
    class_of[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    others = order[OWN_CLASSES:]
    level = (np.cumsum(counts[others]) - counts[others]) * BINS // counts[others].sum()
    class_of[others] = OWN_CLASSES + level
    totals = np.bincount(class_of, counts, OWN_CLASSES + BINS)
    return Vocabulary(class_of, np.log(counts / totals[class_of]), OWN_CLASSES + BINS)


def _count_pairs(words: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words.n_classes
        total = np.zeros((n + 1) * n, np.int64)
        for row in _each(batches):
            texts = _Texts(row)
            tokens, sizes = texts.training(words.class_of[texts.ids].astype(np.int64))
            before = np.concatenate([[n], tokens[:-1]]) if len(tokens) else tokens
            before[np.cumsum(sizes) - sizes] = n
            total += np.bincount(before * n + tokens, minlength=len(total))
        used = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["pair", "n"])

    return run


def table(pairs: np.ndarray, n: int) -> np.ndarray:
    """Log probabilities of a class after each class or the begin, smoothed by the classes' own."""
    counts = pairs.reshape(n + 1, n).astype(float)
    alone = (counts.sum(0) + 1) / (counts.sum() + n)
    return np.log((counts + PRIOR * alone) / (counts.sum(1, keepdims=True) + PRIOR))


def _train_part(model: attention.Model, words: Vocabulary, rate: float, turn: int, turns: int):
    """Train a copy on the round's windows of this partition; its weights, times the number of windows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        kept, waiting = [], 0
        for row in _each(batches):
            texts = _Texts(row)
            tokens, sizes = texts.training(words.class_of[texts.ids])
            laid, at, _ = attention.windows(tokens, sizes, model.begin, model.pad)
            at = at[turn::turns]
            kept.append(laid[at[:, None] + np.arange(attention.KEYS + 1)])
            waiting += len(at)
            if waiting >= 4096:
                yield from _shuffled(kept)
                kept, waiting = [], 0
        yield from _shuffled(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.copy()
        seen = own.train(blocks(batches), rate)
        if seen:
            flat = own.flat().astype(np.float64) * seen
            columns = [np.arange(len(flat)), flat, np.full(len(flat), seen)]
            yield pa.record_batch([pa.array(c) for c in columns], ["at", "value", "seen"])

    return run


def _shuffled(kept: list[np.ndarray]) -> Iterator[np.ndarray]:
    if kept:
        rows = np.concatenate(kept)
        rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]
        for start in range(0, len(rows), attention.BATCH):
            yield rows[start : start + attention.BATCH]


@dataclass
class LanguageModel:
    words: Vocabulary
    attention: attention.Model


def fit(parts: DataFrame, size: int, rates: tuple[float, ...] = RATES) -> LanguageModel:
    """The model from all training texts of the chunks, whose ids are below `size`.

    What comes to the driver is bounded by the vocabulary, the pairs of classes and the weights.
    """
    counted = map_arrow(parts.select("train", "lengths", "ids", "vocabulary"), _count_ids, "id long, n long")
    counts = np.zeros(max(size, OWN_CLASSES + BINS), np.int64)
    for row in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    words = vocabulary(counts)
    needed = parts.select("chunk", "held", "sizes", "words", "wide", "lengths", "ids", "vocabulary")
    pairs = np.zeros((words.n_classes + 1) * words.n_classes, np.int64)
    found = map_arrow(needed, _count_pairs(words), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    model = attention.Model(table(pairs, words.n_classes))
    for turn, rate in enumerate(rates):
        copies = map_arrow(needed, _train_part(model, words, rate, turn, len(rates)), "at long, value double, seen long")
        averaged = copies.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow()
        if averaged.num_rows:
            at = averaged.column("at").to_numpy()
            model.load(averaged.column("value").to_numpy()[np.argsort(at)])
    return LanguageModel(words, model)


def _score_part(model: LanguageModel, total: int, distinct: int, n_buckets: int):
    """A chunk and the counts of its words -> its texts with their scores."""

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        (row,) = _each(chunk.to_batches())
        texts = _Texts(row)
        first = np.cumsum(texts.sizes) - texts.sizes
        bucket = np.array(row["keys"], np.int64).view(np.uint64) % np.uint64(n_buckets)
        known = np.zeros(len(bucket), np.int64)
        for part in _each(counts.to_batches()):
            known[bucket == part["bucket"]] = np.frombuffer(part["counts"], np.int64)
        base = np.log10(known + 1.0) - np.log10(total + distinct + 1.0)
        own = model.words.class_of[texts.ids]
        laid, at, place = attention.windows(own, texts.id_sizes, model.attention.begin, model.attention.pad)
        logs = model.attention.log_probabilities(laid, at)[place] + model.words.share[texts.ids]
        id_first = np.cumsum(texts.id_sizes) - texts.id_sizes
        columns = [
            pa.array(row["doc_ids"], pa.int64()),
            pa.array(row["held"], pa.bool_()),
            pa.array(texts.sizes),
            pa.array(np.add.reduceat((known > 0)[texts.words].astype(np.int64), first)),
            pa.array(np.full(len(first), total, np.int64)),
            pa.array(np.add.reduceat(base[texts.words], first)),
            pa.array(np.add.reduceat(logs, id_first) / np.log(10)),
        ]
        give_back()
        return pa.table(columns, names)

    return run


def score(docs: DataFrame, tokenizer: str, rates: tuple[float, ...] = RATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of `docs`.

    Learns from texts whose CRC-32 of the doc_id's text, modulo 7, is not 2; a null doc_id is learnt
    from. Words are runs of other bytes than space and 0x09 to 0x0D, A-Z lower-cased, then an end.
    base_score: the sum of log10((c + 1) / (N + V + 1)) over words and end, by their counts c in the N
    training tokens, V of them distinct; words are told apart by 64-bit hashes. score: log10 of the
    attention model's probability of the text's subword ids and an end; it trains on every window of the
    training texts, in as many rounds as there are `rates` (none: the pairs of classes alone). Null and empty texts have
    the end alone; repeated rows are scored (and learnt from) each; other columns are ignored; no rows
    give no rows, and without training rows all words are unknown.
    """
    parts = chunks(docs, tokenizer)
    told = parts.agg(F.sum(F.size("keys")).alias("entries"), F.max("vocabulary").alias("size")).first()
    n_buckets = (told["entries"] or 0) // BUCKET_ENTRIES + 1
    counts = word_counts(parts, n_buckets)
    sums = counts.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"),
    ).first()
    model = fit(parts, told["size"] or 0, rates)
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    # A chunk at a time, with the counts of its words: tasks hold no more, however many chunks they get.
    rows = parts.drop("train").groupBy("chunk").cogroup(counts.select("chunk", "bucket", "counts").groupBy("chunk"))
    return rows.applyInArrow(_score_part(model, sums["n"], sums["distinct"], n_buckets), schema)
