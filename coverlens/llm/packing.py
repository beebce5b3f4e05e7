"""Best-fit packing of tokenized documents into sequences, planned on the histogram of lengths.

Documents are tokenized once; only longer ones are cut. How many pieces have each length is a table
of at most `capacity` rows; best-fit decreasing runs over its counts, so the plan does not grow with
the documents: a run says that the pieces of one length from rank r on, so many of them, go one each
into consecutive sequences at one offset. Each piece then takes the slot of its rank in its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, slices, text_bytes, values, written
from coverlens.llm.tokens import ChunkTokenizer

CAPACITY = 2048
END_ID = 0
#: Ranks are counted in so many parts of each length, so that no length is ranked by one task.
RANK_PARTS = 256
_TEXT_BYTES = 1_000_000


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids, cut where over `capacity`.

    ids: little-endian unsigned 32-bit integers; ids_crc32 is their CRC. A null or empty text is its
    end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkTokenizer.of(tokenizer)
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "body", _TEXT_BYTES):
                out: list[list] = [[] for _ in range(6)]
                for doc_id, ids in zip(
                    values(batch.column("doc_id")), encoder.encode(batch.column("body")), strict=True
                ):
                    ids = memoryview(ids + end)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                n = 6 if with_ids else 5
                yield pa.record_batch(arrays[:n], names[:n])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_arrow(rows, run, schema + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, first sequence, offset)."""
    runs: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number)
    rooms: list[int] = []  # those of open_at, sorted
    n_sequences = 0

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            if not open_at[room]:
                insort(rooms, room)
            open_at[room].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, number = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
            taken = min(left, number)
            runs.append((length, rank, taken, first, capacity - room))
            keep(room - length, first, taken)
            keep(room, first + taken, number - taken)
            rank, left = rank + taken, left - taken
        fit = capacity // length
        for number, layers in ((left // fit, fit), (1, left % fit)):
            if not number or not layers:
                continue
            for layer in range(layers):
                runs.append((length, rank, number, n_sequences, layer * length))
                rank += number
            keep(capacity - layers * length, n_sequences, number)
            n_sequences += number
    return runs


def _ranked(cut: DataFrame) -> DataFrame:
    """Adds `rank`, counted from 0 within each length."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int")
    cut = cut.withColumn("part", part)
    # At most capacity * RANK_PARTS rows, whatever the input.
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("length").alias("of_length"),
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("inside", F.row_number().over(inside) - 1)
    same = (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))
    return ranked.join(F.broadcast(sizes), same).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document's ids are the tokenizer's and the end id; documents of more than `capacity` ids are
    cut into pieces of that many, the last one shorter. Every piece lies in one sequence of at most
    `capacity` ids, gapless from offset 0. Null and empty texts have one id; repeated rows are packed
    each; null ids stay null; other columns are ignored; no documents give no rows.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(plan(counts, capacity) or [(0, 0, 0, 0, 0)], np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    starts = {length: np.searchsorted(runs[:, 0], [length, length + 1]).tolist() for length in counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                rows = length == one
                low, high = starts[int(one)]
                slot[rows] = low + np.searchsorted(runs[low:high, 1], rank[rows], "right") - 1
            sequence = runs[slot, 3] + rank - runs[slot, 1]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*kept, pa.array(sequence), pa.array(runs[slot, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = _ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return map_arrow(ranked, run, schema)


def sequences(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """(sequence_id, ids array<long>, doc_ids array<long>): the packed sequences themselves.

    doc_id must be unique here. A group holds at most `capacity` ids.
    """
    slots = pack(docs, tokenizer, capacity, end_id).select("doc_id", "piece", "sequence_id", "offset")
    parts = pieces(docs, tokenizer, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    placed = slots.join(parts, ["doc_id", "piece"]).groupBy("sequence_id")
    whole = placed.agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = values(batch.column("parts"))
            ids = [np.frombuffer(b"".join(p["ids"] for p in own), "<u4").astype(np.int64) for own in rows]
            yield pa.record_batch(
                [
                    batch.column("sequence_id"),
                    pa.array(ids, pa.list_(pa.int64())),
                    pa.array([[p["doc_id"] for p in own] for own in rows], pa.list_(pa.int64())),
                ],
                ["sequence_id", "ids", "doc_ids"],
            )

    return map_arrow(whole, run, "sequence_id long, ids array<long>, doc_ids array<long>")
