"""Writers. None of them replaces existing output unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.operators.ranges import equal_cuts, range_number

ROW_GROUP_ROWS = 122_880
# a file is written by one task, from as many rows as that task sorts
FILE_ROWS = 5_000_000


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_parquet(df: DataFrame, path: str, *, overwrite: bool = False, mode: str | None = None) -> None:
    """ZSTD Parquet with row groups small enough to be skipped by a filter."""
    (
        df.write.mode(mode or _mode(overwrite))
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", str(ROW_GROUP_ROWS))
        .parquet(path)
    )


def file_cuts(
    df: DataFrame, position: str, rows_per_file: int | None = None, extent: tuple[int, int] | None = None
) -> list[int]:
    """Where the files of an ordered table begin, but the first: every ``rows_per_file`` rows.

    By default as many rows as keep all cores busy, one row group at least and ``FILE_ROWS`` at most.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_cores = lambda rows: min(FILE_ROWS, max(ROW_GROUP_ROWS, -(-rows // cores)))
    return equal_cuts(df, position, rows_per_file or by_cores, extent=extent)


def in_position_order(
    df: DataFrame,
    position: str,
    rows_per_file: int | None = None,
    *,
    counted: DataFrame | None = None,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Global order by a numbering, one partition per output file (``file_cuts``).

    The numbers may have gaps of any size: the files' boundaries are counted, on ``counted`` where a
    cheaper table holds the same numbers. ``df`` itself is not read for it, and its rows move once, to
    the file that their number names. Rows without a number come first.
    """
    cuts = file_cuts(df if counted is None else counted, position, rows_per_file, extent)
    target = range_number(F.col(position).cast("long"), cuts)
    return df.repartitionById(len(cuts) + 1, target).sortWithinPartitions(position)


def write_ordered(
    df: DataFrame,
    path: str,
    position: str,
    last_position: int | None = None,
    *,
    rows_per_file: int | None = None,
    overwrite: bool = False,
    counted: DataFrame | None = None,
) -> None:
    """Parquet whose files, read in name order, are sorted by ``position``.

    ``last_position``, where known, says that the numbers are 1 to that one and spares a pass.
    """
    extent = None if last_position is None else (1, last_position)
    ordered = in_position_order(df, position, rows_per_file, counted=counted, extent=extent)
    write_parquet(ordered, path, overwrite=overwrite)


def write_csv_report(
    df: DataFrame, path: str, *, single_file: bool = True, overwrite: bool = False
) -> None:
    """CSV with a header; ``single_file`` is for finished report tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(_mode(overwrite)).option("header", True).csv(path)
