"""Whether a stored table's rows rise strictly in a numbering, told from ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rising_ranges(table: DataFrame, column: str) -> DataFrame:
    """(file, start, first, last, rises): one row per byte range of a stored table, as a task reads it.

    ``rises`` says that the whole numbers of ``column`` rise strictly over the range's rows and that none
    is NULL. Only that column is read, and nothing is shuffled but the ranges.
    """
    places = ["file", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, last, rises = None, 0, 0, True
        done: list[tuple] = []
        for batch in batches:
            start = np.array(batch.column("start").to_pylist(), np.int64)
            file = np.array(batch.column("file").to_pylist(), object)
            numbers, known = batch.column("n").fill_null(0).to_numpy(), batch.column("n").is_valid().to_numpy(zero_copy_only=False)
            opens = np.append(True, (start[1:] != start[:-1]) | (file[1:] != file[:-1])) if len(start) else []
            bounds = [*np.nonzero(opens)[0], len(start)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                own, place = numbers[low:high], (file[low], int(start[low]))
                if place != current:
                    if current is not None:
                        done.append((*current, first, last, rises))
                    current, first, rises = place, int(own[0]), True
                else:
                    rises = rises and own[0] > last
                rises = bool(rises and known[low:high].all() and (own[1:] > own[:-1]).all())
                last = int(own[-1])
        if current is not None:
            done.append((*current, first, last, rises))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*places, "first", "last", "rises"])

    rows = table.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col(column).cast("long").alias("n")
    )
    return rows.mapInArrow(run, "file string, start long, first long, last long, rises boolean")


def all_different(table: DataFrame, column: str) -> bool:
    """True if the ranges of a stored table rise and do not overlap, so that no number repeats.

    False proves nothing: the numbers may differ all the same.
    """
    ranges = rising_ranges(table, column)
    before = F.lag("last").over(Window.orderBy("first"))  # a row per byte range
    apart = F.coalesce(F.col("first") > before, F.lit(True))
    row = ranges.select("rises", apart.alias("apart")).agg(F.min(F.col("rises") & F.col("apart"))).first()
    return row[0] is not False
