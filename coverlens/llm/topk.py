"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are packed into blocks, and these are dealt out to lanes; a group holds a lane of
queries and a lane of candidates, so that a block travels once for each lane of the other side, and no
pair of blocks is ever a row. Every pair of blocks is scored by one matrix product, again in every pass
rather than kept. A pass counts, for each query, its scores per bin of the range that holds the k-th
highest, and the next pass refines that bin, until it is a single score. Then the scores at or above it
are collected and ties are broken by the smaller id.

A group reports bins only down to its own k-th score: the k-th over all candidates cannot lie lower, so a
report has at most k bins, and a query's reports never grow with the table's width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import give_back, map_arrow, ship, written

K = 20
BINS = 1024
QUERY_ROWS = 1024
CANDIDATE_ROWS = 4096
#: Components a row of a block has on average, at most: blocks of longer vectors have fewer rows.
WIDTH = 64
#: Blocks of queries and of candidates that a group should hold at most.
QUERY_LANE = 32
CANDIDATE_LANE = 32
#: Groups for each core, if there are enough blocks.
GROUPS_A_CORE = 4
#: Scores must be smaller than this in absolute value.
LARGEST = 2**61
_BLOCKS = "dim int, block long, n int, largest double, ids binary, kind string, matrix binary"
_KINDS = (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31))


def _kind(largest: float) -> str:
    """The narrowest type that holds all integers up to this one, by absolute value."""
    return next((kind for kind, limit in _KINDS if largest < limit), "<f8")


def _pack(limit: int):
    """Rows (vec_id, embedding) into blocks of at most `limit` floored vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n_blocks = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("embedding")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            flat = np.floor(flat.astype(np.float64))
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.nonzero(sizes == dim)[0]
                most = max(1, limit * WIDTH // max(int(dim), WIDTH))
                for start in range(0, len(rows), most):
                    own = rows[start : start + most]
                    matrix = flat[at[own][:, None] + np.arange(dim)]
                    largest = float(np.abs(matrix).max()) if matrix.size else 0.0
                    kind = _kind(largest)
                    packed = ids[own].tobytes(), kind, matrix.astype(kind).tobytes()
                    row = (int(dim), base + n_blocks, len(own), largest, *packed)
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.string(), pa.binary()]
                    names = ["dim", "block", "n", "largest", "ids", "kind", "matrix"]
                    yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                    n_blocks += 1

    return run


def _vectors(table: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, embedding array<double>): the rows that take part, scaled but not yet floored."""
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(float(scale))))


def _scores(query: np.ndarray, candidate: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products, exact: by floats only as far as these hold all integers.

    largest: no product of two components exceeds it by absolute value.
    """
    bound = largest * max(1, query.shape[1])
    if bound < 2**24:
        return query.astype(np.float32) @ candidate.astype(np.float32).T
    if bound < 2**53:
        return query.astype(np.float64) @ candidate.astype(np.float64).T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(query) @ whole(candidate).T if query.size and candidate.size else np.zeros((len(query), len(candidate)))
    if (np.abs(exact) >= LARGEST).any():
        raise OverflowError(f"an inner product reaches {LARGEST}")
    return exact.astype(np.int64)


def _block(rows: pa.Table, at: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, vectors, largest component) of a row."""
    ids, kind, matrix, largest = (rows.column(prefix + c)[at].as_py() for c in ("ids", "kind", "matrix", "largest"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(matrix, kind).reshape(len(ids), -1), largest


def _tiles(asked: pa.Table, still_open: bool) -> Iterator[tuple]:
    """Some queries at a time: (block, rows, ids, vectors, largest component, low, high, above)."""
    for at in range(asked.num_rows):
        ids, query, largest = _block(asked, at, "q_")
        low, high, above = (asked.column(c)[at].values.to_numpy() for c in ("low", "high", "above"))
        rows = np.nonzero(high - low > 1)[0] if still_open else np.arange(len(ids))
        for start in range(0, len(rows), 256):
            own = rows[start : start + 256]
            yield asked.column("q_block")[at].as_py(), own, ids[own], query[own], largest, low[own], high[own], above[own]


def _picked(tile: tuple, block: tuple, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, id, score) of a tile's pairs with a block whose scores are in the queries' ranges."""
    _, _, own_ids, query, largest, *_ = tile
    ids, candidate, c_largest = block
    scores = _scores(query, candidate, largest * c_largest)
    # Limits that the scores' type rounds lie beyond all scores.
    inside = scores >= low.astype(scores.dtype)[:, None]
    if high is not None:
        inside &= scores < high.astype(scores.dtype)[:, None]
    q, c = np.nonzero(inside)
    other = ids[c] != own_ids[q]
    q, c = q[other], c[other]
    return q, ids[c], scores[q, c].astype(np.int64)


def _made(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    columns = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(len(names))]
    give_back()
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def _count_bins(k: int):
    """Queries with their ranges, and candidates -> (q_block, q_row, bin, n)."""

    def run(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        blocks, parts = [_block(candidates, at) for at in range(candidates.num_rows)], []
        for tile in _tiles(asked, still_open=True) if blocks else ():
            q_block, rows, *_, low, high, above = tile
            width = -((low - high) // BINS)
            counts = np.zeros((len(rows), BINS), np.int64)
            least = low
            for block in blocks:
                q, _, score = _picked(tile, block, least, high)
                bins = (score - low[q]) // width[q]
                counts += np.bincount(q * BINS + bins, minlength=counts.size).reshape(counts.shape)
                upto = counts[:, ::-1].cumsum(1)[:, ::-1]
                # Scores below the bin of the group's own k-th are told to nobody.
                kth = np.count_nonzero(upto >= (k - above)[:, None], axis=1) - 1
                least = low + np.maximum(kth, 0) * width
            q, b = np.nonzero((counts > 0) & (upto - counts < (k - above)[:, None]))
            parts.append([np.full(len(q), q_block), rows[q], b, counts[q, b]])
        return _made(parts, ["q_block", "q_row", "bin", "n"])

    return run


def _keep_best(k: int):
    """Queries with their k-th scores, and candidates -> the up to k rows of each query that may rank."""

    def run(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        blocks, parts = [_block(candidates, at) for at in range(candidates.num_rows)], []
        for tile in _tiles(asked, still_open=False) if blocks else ():
            q_block, rows, own_ids, *_, low, _, _ = tile
            q = ids = score = np.zeros(0, np.int64)
            for block in blocks:
                more = _picked(tile, block, low)
                q, ids, score = (np.concatenate(both) for both in zip((q, ids, score), more, strict=True))
                order = np.lexsort((ids, -score, q))
                q, ids, score = q[order], ids[order], score[order]
                first = np.searchsorted(q, np.arange(len(rows)))
                best = np.arange(len(q)) - first[q] < k
                q, ids, score = q[best], ids[best], score[best]
            parts.append([np.full(len(q), q_block), rows[q], own_ids[q], ids, score])
        return _made(parts, ["q_block", "q_row", "query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about `size` rows, and by how many tasks they were packed."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("numbers")).first()
    parts = max(told["n"] // size, (told["numbers"] or 0) // (size * WIDTH)) + 1
    # Dealt out in turn, so that blocks are of even size whatever the ids are.
    return written(map_arrow(rows.repartition(parts), _pack(2 * size), _BLOCKS), name), parts


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = K,
    scale: float = 64.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Components x count as floor(scale * x), x as double. is_query, a condition on vec_id, picks the
    query rows; candidates are all rows of the same dimension but those with the query's own vec_id.
    Ties go to the smaller vec_id; rows that share both are told apart by no rank. Rows with a null
    id or vector, or a null, NaN or infinite component, take no part. Fewer than k candidates give
    fewer rows, none give none. A score beyond a long raises OverflowError.
    """
    rows = written(_vectors(table, vec_id, embedding, scale), "vectors")
    candidates, packed = _blocks(rows, CANDIDATE_ROWS, "candidates")
    queries, q_packed = _blocks(rows.where(is_query), QUERY_ROWS, "queries")
    queries = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "n", "largest", "ids", "kind", "matrix")])
    # No score exceeds dim * the product of the largest components.
    widest = candidates.groupBy("dim").agg(F.max("largest").alias("c_largest"))
    bound = F.col("dim") * F.col("c_largest") * F.col("q_largest")
    bound = F.least(bound, F.lit(float(LARGEST))).cast("long") + 2
    ranges = queries.join(widest, "dim").withColumn("bound", bound)
    state = ranges.select("q_block", F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("q_row"), "bound")
    state = written(
        state.select(
            "q_block",
            F.col("q_row").cast("long").alias("q_row"),
            (-F.col("bound")).alias("low"),
            F.col("bound").alias("high"),
            F.lit(0).cast("long").alias("above"),
        ),
        "state",
    )

    spark = table.sparkSession
    ship(spark)
    q_lanes = -(-q_packed // QUERY_LANE)
    lanes = min(packed, GROUPS_A_CORE * spark.sparkContext.defaultParallelism // q_lanes)
    lanes = max(-(-packed // CANDIDATE_LANE), lanes)

    def lane(block: str, n: int) -> Column:
        """A block's lane: the tasks that packed the blocks are dealt out in turn."""
        return F.pmod(F.shiftright(block, 32), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = candidates.withColumn("lane", lane("block", lanes)).withColumn("q_lane", every(q_lanes))

    def grouped(state: DataFrame, function, schema: str) -> DataFrame:
        """A function of each lane of queries, with what is known of them, and each lane of candidates.

        Nothing that grows with the tables is broadcast.
        """
        known = state.groupBy("q_block").agg(
            F.sort_array(F.collect_list(F.struct("q_row", "low", "high", "above"))).alias("state")
        )
        ranges = [F.col("state").getField(c).alias(c) for c in ("low", "high", "above")]
        asked = queries.join(known.hint("merge"), "q_block").select(*queries.columns, *ranges)
        asked = asked.withColumn("q_lane", lane("q_block", q_lanes)).withColumn("lane", every(lanes))
        keys = ["dim", "q_lane", "lane"]
        return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(function, schema)

    downward = Window.partitionBy("q_block", "q_row").orderBy(F.desc("bin"))
    while state.where("high - low > 1").limit(1).count():
        counted = grouped(state, _count_bins(k), "q_block long, q_row long, bin long, n long")
        counted = counted.groupBy("q_block", "q_row", "bin").agg(F.sum("n").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(downward))
        upto = upto.join(state.hint("merge"), ["q_block", "q_row"]).where("above + upto >= %d" % k)
        found = upto.groupBy("q_block", "q_row").agg(F.max(F.struct("bin", "upto", "n")).alias("kth"))
        width = F.expr(f"-((low - high) div {BINS}) + if((high - low) % {BINS} = 0, 0, 1)")
        low = F.col("low") + F.col("kth.bin") * width
        state = state.join(found.hint("merge"), ["q_block", "q_row"], "left")
        # Without a k-th score all candidates rank; a single score needs no more passes.
        state = state.select(
            "q_block",
            "q_row",
            F.when(F.col("kth").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("kth").isNull(), F.col("low") + 1)
            .otherwise(F.least(low + width, F.col("high")))
            .alias("high"),
            (F.col("above") + F.coalesce(F.col("kth.upto") - F.col("kth.n"), F.lit(0))).alias("above"),
        )
        state = written(state, "state")

    best = grouped(state, _keep_best(k), "q_block long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
