"""What several operators share: the shared folder, written tables, Arrow batches, text chunks."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROOT = Path(__file__).resolve().parents[2]
_PACKAGE = Path(__file__).resolve().parents[1]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir, or a scratch one in a local session."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="coverlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder, in a folder of this application.

    Nothing below it is needed once the application has ended.
    """
    context = spark.sparkContext
    return f"{shared_folder(spark).rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from the copy: lost executors cost a re-read.

    group_rows: rows of a row group, for rows of megabytes; readers hold as many at a time.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers where neither their path nor folder has it."""
    context = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = context.master.startswith("local[") and Path.cwd() == _ROOT
    if here or _ROOT in on_path or getattr(context, "_coverlens_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="coverlens-code-")) / "coverlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._coverlens_shipped = True


def give_back() -> None:
    """Return what a task has freed to the system: workers wait for later tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """mapInArrow with this package importable on the workers, which give memory back as a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def values(column: pa.Array | pa.ChunkedArray) -> list:
    return column.to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes of the binary column each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
