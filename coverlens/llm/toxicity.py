"""Toxicity by subword bags: character n-gram vectors, averaged, into a linear softmax.

A text's bag holds the character n-grams of its distinct words. The n-gram vectors and the softmax are
trained together in numpy on a bounded sample of labelled texts; n-grams that are about as frequent in
both classes keep a zero vector. As the averaged vector enters linearly, a text's score is the average
of one number per n-gram, so scoring is one pass over the bytes, and a misspelling scores by the
n-grams that it still shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverlens.llm.common import map_arrow, slices, text_bytes, values

#: At most so many labelled texts of each class are learnt from, the least by a hash of their ids.
SAMPLE_ROWS = 2000
GRAMS = (4, 6)
BUCKET_BITS = 18
DIMENSIONS = 4
EPOCHS = 15
RATE = 1.0
#: N-grams in fewer sampled texts, or whose shares of texts differ between the classes by fewer
#: standard errors, are not learnt from.
LEAST_TEXTS = 5
LEAST_DIFFERENCE = 6.0
#: An average counts so many more n-grams of no effect, so that a few do not decide on a short text.
PAD_GRAMS = 200
#: The averages are of the order of a rare n-gram's share of a text; this brings them near one.
GAIN = 64.0
HOLD_OUT = 5
_TEXT_BYTES = 2_000_000


@dataclass
class Model:
    """What each n-gram bucket adds to the log odds of a text, before averaging, and the rest of them."""

    margins: np.ndarray
    bias: float


def distinct_words(text: bytes) -> bytes:
    """The words of a text, A-Z lower-cased, each once in order of its first place."""
    return b" ".join(dict.fromkeys(text.lower().split()))


def gram_buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (positions, buckets) of the n-grams of all texts, laid out one behind another.

    A text takes its length and 2 positions: a blank stands before and after it. A blank may begin
    or end an n-gram but not stand inside, so that a word's first and last ones are told apart.
    """
    codes = np.frombuffer(b"".join(b" " + text + b" " for text in texts), np.uint8).astype(np.uint32)
    blanks = np.concatenate([[0], np.cumsum(codes == 32)])
    mixed = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            return
        mixed = mixed[: len(codes) - n + 1] * np.uint32(16777619) + codes[n - 1 :]
        if n in GRAMS:
            last = len(mixed)
            inside = blanks[n - 1 : n - 1 + last] == blanks[1 : 1 + last]
            at = np.nonzero(inside)[0]
            buckets = (mixed[at] + np.uint32(n)) * np.uint32(2654435761)
            yield at, buckets >> np.uint32(32 - BUCKET_BITS)


def _bounds(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    texts = [distinct_words(text) for text in texts]
    bounds = _bounds(texts)
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for at, buckets in gram_buckets(texts):
        sums = np.concatenate([[0.0], np.cumsum(model.margins[buckets], dtype=np.float64)])
        cuts = np.searchsorted(at, bounds)
        total += np.diff(sums[cuts])
        number += np.diff(cuts)
    logit = model.bias + GAIN * total / (number + PAD_GRAMS)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets and their shares of its n-grams."""
    for batch in batches:
        out = []
        for text in values(batch.column("body")):
            found = [buckets for _, buckets in gram_buckets([distinct_words(text)])]
            buckets, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint32)]), return_counts=True)
            share = (n / (n.sum() + PAD_GRAMS)).astype(np.float32)
            out.append((buckets.astype(np.int32).tobytes(), share.tobytes()))
        columns = [pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)]
        order = [batch.column("doc_id"), batch.column("toxic"), *columns]
        yield pa.record_batch(order, ["doc_id", "toxic", "buckets", "shares"])


def telling(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Which buckets' shares of texts differ clearly between the classes."""
    texts = np.zeros((2, 1 << BUCKET_BITS))
    for (buckets, _), label in zip(bags, labels, strict=True):
        texts[label, buckets] += 1
    n = np.array([[(labels == 0).sum()], [(labels == 1).sum()]])
    share = texts.sum(0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n).sum())
    differs = np.abs(texts[1] / n[1] - texts[0] / n[0]) >= LEAST_DIFFERENCE * error
    return differs & (texts.sum(0) >= LEAST_TEXTS)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, odds: float) -> Model:
    """Vectors and softmax by mini-batches with a step size per vector (Adagrad); deterministic.

    odds: of label 1 among all labelled rows. The sample is weighed as if both classes were as
    frequent; the bias moves half-way to the real odds.
    """
    kept = telling(bags, labels)
    bags = [(buckets[kept[buckets]], shares[kept[buckets]]) for buckets, shares in bags]
    rng = np.random.default_rng(0)
    vectors = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    softmax = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
    softmax[:, 1] = -softmax[:, 0]
    bias = np.zeros(2, np.float32)
    seen, seen_softmax, seen_bias = np.full(len(vectors), 1e-6, np.float32), 1e-6, 1e-6
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * len(labels)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(labels))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            buckets = np.concatenate([bags[r][0] for r in rows])
            shares = np.concatenate([bags[r][1] for r in rows]) * np.float32(GAIN)
            used, place = np.unique(buckets, return_inverse=True)
            parts = vectors[buckets] * shares[:, None]
            hidden = np.stack([np.bincount(owner, parts[:, d], len(rows)) for d in range(DIMENSIONS)], 1)
            logits = hidden @ softmax + bias
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= weight[rows][:, None] / len(rows)
            back = (error @ softmax.T)[owner] * shares[:, None]
            slope = np.stack([np.bincount(place, back[:, d], len(used)) for d in range(DIMENSIONS)], 1)
            slope_softmax, slope_bias = hidden.T @ error, error.sum(0)
            seen[used] += (slope**2).sum(1)
            seen_softmax += (slope_softmax**2).sum()
            seen_bias += (slope_bias**2).sum()
            vectors[used] -= rate * slope / np.sqrt(seen[used])[:, None]
            softmax -= rate * slope_softmax / np.sqrt(seen_softmax)
            bias -= rate * slope_bias / np.sqrt(seen_bias)
    margins = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return Model(margins, float(bias[1] - bias[0] + np.log(odds) / 2))


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HOLD_OUT))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows that are not held out; without rows of both classes, from nothing.

    Only ids and labels pick the sample, at most `sample_rows` of each class; nothing else of
    a document than its whole text is learnt from.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    known = known.where(_remainder() != 0).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -2.0)
    picked = [
        known.where(F.col("toxic") == one).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        for one in (0, 1)
    ]
    # Twice `sample_rows` ids and labels at most.
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    bags = map_arrow(
        texts.join(sample, "doc_id").select("doc_id", "toxic", "body"),
        _bags,
        "doc_id long, toxic int, buckets binary, shares binary",
    )
    rows = sorted(bags.collect(), key=lambda r: (r["doc_id"], r["toxic"], bytes(r["buckets"])))
    if {r["toxic"] for r in rows} != {0, 1}:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -2.0)
    parsed = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return train(parsed, np.array([r["toxic"] for r in rows]), counts[1] / counts[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`, by its whole text.

    Null and empty texts get the score of a text without n-grams. A null doc_id is not held out (and
    never learnt from). Repeated rows are scored each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                found = scores(values(batch.column("body")), model)
                yield pa.record_batch([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    scored = map_arrow(rows, run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their columns."""
    packed = docs.select(F.struct("*").alias("row"), text_bytes().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                found = scores(values(batch.column("body")), model)
                kept = batch.filter(pa.array(found < 0.5))
                yield pa.record_batch([kept.column("row")], ["row"])

    return map_arrow(packed, run, StructType([packed.schema["row"]])).select("row.*")
