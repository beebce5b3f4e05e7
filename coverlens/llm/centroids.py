"""Centroid clustering with exact integer arithmetic, over zone maps in Hilbert order.

Vectors become integers, are ordered along a Hilbert curve and cut into blocks that carry the least and
greatest value of each component. For any vector of a box, the difference of its squared distances to two
centroids is linear in the vector, so its least value over the box is known from the two bounds alone: a
centroid that is farther than another one everywhere in the box is no candidate of the block. The
candidates left are compared exactly. A round moves k sums a partition, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import map_arrow, written

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2:"
#: Vectors of a block.
BLOCK_ROWS = 64
#: Bits of a component in the Hilbert order; it decides on the boxes, not on the results.
CURVE_BITS = 4
#: Integers beyond it have squared distances that a long may not hold.
LARGEST = 1 << 27
_FLOAT_EXACT = 2.0**53


def quantised(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x) of the vectors that take part.

    Rows without an id, and vectors that are null, of another length, or hold a null or non-finite
    component, take no part. A component whose integer is beyond 2^27 ends the job with an error that
    names the row: its distances might not fit a long.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(F.size("e") == dims).where(~odd)
    scaled = F.transform("e", lambda x: x.cast("double") * F.lit(float(scale)))
    rows = rows.select("vec_id", scaled.alias("e"))
    too_far = F.exists("e", lambda x: (x >= float(LARGEST)) | (x < -float(LARGEST)))
    refused = F.raise_error(F.concat(F.lit("vector "), F.col("vec_id"), F.lit(" has a component beyond the range")))
    whole = F.transform("e", lambda x: F.floor(x).cast("long"))
    return rows.select("vec_id", F.when(too_far, refused.cast("array<long>")).otherwise(whole).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cell numbers (below 2^bits), as bytes in order.

    The curve's place is the Gray code of the cell, after the turns and reflections that each coarser
    level applies to the finer ones.
    """
    axes = cells.astype(np.uint8).copy()
    n_axes = axes.shape[1]
    for level in range(bits - 1, 0, -1):
        below = np.uint8((1 << level) - 1)
        for axis in range(n_axes):
            upper = (axes[:, axis] >> level & 1).astype(bool)
            swapped = (axes[:, 0] ^ axes[:, axis]) & below
            swapped[upper] = 0
            axes[upper, 0] ^= below
            axes[:, 0] ^= swapped
            axes[:, axis] ^= swapped
    gray = np.bitwise_xor.accumulate(axes, axis=1)
    parity = np.zeros(len(axes), np.uint8)
    for level in range(bits - 1, 0, -1):
        parity ^= np.where(gray[:, -1] >> level & 1, (1 << level) - 1, 0).astype(np.uint8)
    gray ^= parity[:, None]
    planes = [gray >> level & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _keyed(points: DataFrame, dims: int, bits: int) -> DataFrame:
    """`points` with their Hilbert key; cells span two standard deviations on either side of the mean."""
    moments = [f(F.element_at("v", i + 1)).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.avg, F.stddev_pop)]
    row = points.agg(*moments).first()
    mean = np.array([row[f"avg{i}"] or 0.0 for i in range(dims)])
    spread = np.array([row[f"stddev_pop{i}"] or 0.0 for i in range(dims)])
    by_spread = np.argsort(-spread, kind="stable")
    width = np.where(spread > 0, 4 * spread / (1 << bits), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((_matrix(batch.column("v"), dims) - mean) / width) + (1 << bits - 1)
            cells = np.clip(cells, 0, (1 << bits) - 1)[:, by_spread]
            keys = [key.tobytes() for key in hilbert_keys(cells, bits)]
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(keys, pa.binary())], ["vec_id", "v", "key"])

    return map_arrow(points, run, "vec_id long, v array<long>, key binary")


def zone_maps(points: DataFrame, dims: int = DIMS, block_rows: int = BLOCK_ROWS, bits: int = CURVE_BITS) -> DataFrame:
    """Written blocks (n, low, high, ids, matrix) of `points`, neighbours along the Hilbert curve.

    Equal vectors share a key; their places in the written table part them over the sort's ranges.
    """
    keyed = written(_keyed(points, dims, bits), "hilbert")
    place = F.xxhash64("vec_id", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    ordered = keyed.select("*", place.alias("place"))
    ordered = ordered.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            matrix = _matrix(batch.column("v"), dims)
            small = bool((matrix.astype(np.int16) == matrix).all())
            stored = matrix.astype(np.int16 if small else np.int32)
            out: dict[str, list] = {name: [] for name in ("n", "low", "high", "ids", "matrix")}
            for start in range(0, len(ids), block_rows):
                own = stored[start : start + block_rows]
                out["n"].append(len(own))
                out["low"].append(own.min(0).astype(np.int32).tobytes())
                out["high"].append(own.max(0).astype(np.int32).tobytes())
                out["ids"].append(ids[start : start + block_rows].tobytes())
                out["matrix"].append(own.tobytes())
            kinds = [pa.int32()] + [pa.binary()] * 4
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return written(map_arrow(ordered, run, "n int, low binary, high binary, ids binary, matrix binary"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that may be nearest to (or tie at) some point of the box."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    middle = (low + high) // 2
    rival = ((centroids - middle) ** 2).sum(1).argmin()
    apart = 2 * (centroids[rival] - centroids)
    # least over the box of |x - c|^2 - |x - rival|^2
    least = (centroids**2).sum(1) - (centroids[rival] ** 2).sum()
    least = least + np.where(apart > 0, apart * low, apart * high).sum(1)
    return np.nonzero(least <= 0)[0]


def nearest(matrix: np.ndarray, among: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; the smaller number wins ties."""
    own = centroids[among]
    reach = float(np.abs(matrix).max(initial=0)) + float(np.abs(own).max(initial=0))
    if 2 * matrix.shape[1] * reach**2 < _FLOAT_EXACT:  # floats hold every integer that occurs
        points, middles = matrix.astype(np.float64), own.astype(np.float64)
        distances = (middles**2).sum(1) - 2 * (points @ middles.T)
        best = distances.argmin(1)
        least = distances[np.arange(len(points)), best] + (points**2).sum(1)
    else:
        points = matrix.astype(np.int64)
        distances = np.stack([((points - middle) ** 2).sum(1) for middle in own], axis=1)
        best = distances.argmin(1)
        least = distances[np.arange(len(points)), best]
    return among[best], least.astype(np.int64)


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    columns = [batch.column(c).to_pylist() for c in ("n", "low", "high", "ids", "matrix")]
    for n, low, high, ids, matrix in zip(*columns, strict=True):
        kind = np.int16 if len(matrix) == 2 * n * dims else np.int32
        points = np.frombuffer(matrix, kind).reshape(n, dims)
        yield np.frombuffer(low, np.int32), np.frombuffer(high, np.int32), np.frombuffer(ids, np.int64), points


def _sums(dims: int, centroids: np.ndarray):
    """Blocks -> (cluster, n, sums) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims), np.int64)
        n = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for low, high, _, points in _blocks(batch, dims):
                among = candidates(low, high, centroids)
                cluster, _ = nearest(points, among, centroids)
                member = cluster[None, :] == among[:, None]
                total[among] += (member.astype(np.float64) @ points.astype(np.float64)).astype(np.int64)
                n[among] += member.sum(1)
        used = np.nonzero(n)[0]
        columns = [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["cluster", "n", "sums"])

    return run


def _moved(blocks: DataFrame, dims: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the next round; at most k x dims sums come to the driver."""
    parts = map_arrow(blocks, _sums(dims, centroids), "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    sums = sums.groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    moved = centroids.copy()
    for row in sums.collect():
        moved[row["cluster"], row["dim"]] = int(row["total"]) // row["n"]
    return moved


def _assign(dims: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, ids, points in _blocks(batch, dims):
                cluster, distance = nearest(points, candidates(low, high, centroids), centroids)
                columns = [pa.array(ids), pa.array(cluster, pa.int32()), pa.array(distance)]
                yield pa.record_batch(columns, ["vec_id", "cluster", "distance"])

    return run


def starting_vectors(points: DataFrame, k: int, seed: str = SEED) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed` and their id; the vector itself settles ties."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in points.orderBy(order, "v").limit(k).collect()]


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: float = SCALE,
    seed: str = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that takes part.

    `quantised` tells which rows take part. Centroids start as `starting_vectors`; each round gives every
    vector to the nearest one (ties: the smaller number) and moves those with vectors to the floor of
    their mean. Fewer than k vectors give fewer centroids. Repeated rows count and are returned as often
    as they come; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    points = quantised(vectors, dims, scale)
    centroids = np.array(starting_vectors(points, k, seed), np.int64).reshape(-1, dims)
    blocks = zone_maps(points, dims, block_rows)
    for _ in range(rounds):
        centroids = _moved(blocks, dims, centroids)
    assigned = written(map_arrow(blocks, _assign(dims, centroids), "vec_id long, cluster int, distance long"), "assigned")

    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = assigned.groupBy("cluster").agg(exact.alias("own"))  # at most k rows
    inertia = inertia.select(
        "cluster",
        F.col("own").cast("long").alias("cluster_inertia"),
        F.sum("own").over(Window.partitionBy()).cast("long").alias("inertia"),
    )
    digests = [(i, centroid_digest(c)) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    about = F.broadcast(inertia.join(F.broadcast(named), "cluster"))
    return assigned.join(about, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
