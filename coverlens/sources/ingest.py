"""CSV to Parquet without changing a value."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens import schema
from coverlens.sources.records import can_cut, cut_records, read_cut
from coverlens.sources.sinks import write_parquet
from coverlens.sources.store import exists, is_complete, move


class ConversionFailed(RuntimeError):
    """The written Parquet does not mirror its CSV."""


_CSV = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}


def pinned_schema(
    spark: SparkSession,
    path: str,
    pins: Sequence[str] = schema.IDENTIFIER_COLUMNS,
    csv_options: Mapping[str, object] | None = None,
    cut: tuple[DataFrame, str] | None = None,
) -> T.StructType:
    """Types inferred from every row, except the identifiers in ``pins``, which stay text.

    Inference alone would read a postal code as a number and drop its leading zero. Timestamps
    are kept free of a time zone. ``cut``: the records of a ``multiLine`` file, if they are cut already.
    """
    options = {**_CSV, **(csv_options or {}), "inferSchema": True, "samplingRatio": 1.0}
    inferred = _read(spark, path, options, cut or _cut(spark, path, options)).schema
    missing = [p for p in pins if p not in inferred.names]
    if missing:
        raise ConversionFailed(f"pinned columns not in the file: {missing}")

    def final(field: T.StructField) -> T.DataType:
        if field.name in pins:
            return T.StringType()
        if isinstance(field.dataType, T.TimestampType):
            return T.TimestampNTZType()
        return field.dataType

    return T.StructType([T.StructField(f.name, final(f), True) for f in inferred])


def _cut(spark: SparkSession, path: str, options: Mapping[str, object]) -> tuple[DataFrame, str] | None:
    """Records with line breaks in quotes (``multiLine``), cut in parallel where the options allow it."""
    if str(options.get("multiLine", "")).lower() == "true" and can_cut(options):
        return cut_records(spark, path)
    return None


def _read(
    spark: SparkSession,
    path: str,
    options: Mapping[str, object],
    cut: tuple[DataFrame, str] | None,
    types: T.StructType | None = None,
) -> DataFrame:
    if cut is not None:
        return read_cut(spark, path, options, types, cut)
    reader = spark.read.options(**options)
    return (reader if types is None else reader.schema(types)).csv(path)


def convert_csv(
    spark: SparkSession,
    source: str,
    target: str,
    pins: Sequence[str] = schema.IDENTIFIER_COLUMNS,
    *,
    types: T.StructType | None = None,
    leading_zero_column: str | None = "zip_code",
    csv_options: Mapping[str, object] | None = None,
    overwrite: bool = False,
) -> dict:
    """Convert, prove it, then publish: same rows, same columns, identifiers still text.

    The copy is written beside ``target`` and moved there once it is verified, so ``target`` never
    holds unproven data. The proof of the CSV is taken while it is written, so it is not read again. Sentinel codes are left as they are. Pass ``types`` to skip the inference
    pass over a large release whose schema is known, and ``csv_options`` for reader options such as
    ``multiLine`` (line breaks within quotes; such a file is cut in parallel, see
    ``sources.records``). Returns the numbers that were checked.
    """
    if not overwrite and exists(spark, target):
        raise FileExistsError(f"{target} is there already; overwrite=True replaces it")
    options = {**_CSV, **(csv_options or {})}
    cut = _cut(spark, source, options)
    types = types or pinned_schema(spark, source, pins, csv_options, cut)
    rows = _read(spark, source, options, cut, types)
    unproven = f"{target.rstrip('/')}-unproven-{uuid.uuid4().hex[:12]}"
    told = Observation()
    write_parquet(rows.observe(told, *_proof(rows, leading_zero_column)), unproven)
    found = verify_conversion(rows, spark.read.parquet(unproven), pins, leading_zero_column, told.get)
    move(spark, unproven, target)
    return found


def _proof(df: DataFrame, leading_zero_column: str | None) -> list[Column]:
    """What two copies of a table must agree on: rows, values per column, and a sum over row hashes.

    The hash passes over NULLs, so each column's absence is hashed beside it. Sums do not depend on
    the order of rows, and need no shuffle.
    """
    names = [f"`{c}`" for c in df.columns]
    parts = [part for c in names for part in (F.col(c), F.col(c).isNull())]
    zeros = F.count_if(F.col(leading_zero_column).startswith("0")) if leading_zero_column else F.max(F.lit(None).cast("long"))
    return [
        F.count(F.lit(1)).alias("rows"),
        zeros.alias("zeros"),
        F.sum(F.xxhash64(*parts).cast("decimal(38,0)")).alias("content"),
        *[F.count(F.col(c)).alias(f"values_{i}") for i, c in enumerate(names)],
    ]


def verify_conversion(
    source: DataFrame,
    written: DataFrame,
    pins: Sequence[str],
    leading_zero_column: str | None,
    observed: Mapping[str, object] | None = None,
) -> dict:
    """Raise ``ConversionFailed`` unless ``written`` holds what ``source`` did, cell by cell.

    ``observed`` is the proof taken of ``source`` while it was written (``_proof``); without it the
    source is read for it.
    """
    wrong = [p for p in pins if not isinstance(written.schema[p].dataType, T.StringType)]
    if wrong:
        raise ConversionFailed(f"identifiers stored as numbers: {wrong}")
    if written.columns != source.columns:
        raise ConversionFailed(f"columns differ: {source.columns} -> {written.columns}")
    if observed is None:
        observed = source.agg(*_proof(source, leading_zero_column)).first().asDict()
    kept = written.agg(*_proof(written, leading_zero_column)).first().asDict()
    if observed["rows"] != kept["rows"]:
        raise ConversionFailed(f"row counts differ: {observed['rows']} -> {kept['rows']}")
    fewer = [c for i, c in enumerate(source.columns) if observed[f"values_{i}"] != kept[f"values_{i}"]]
    if fewer:
        raise ConversionFailed(f"numbers of values differ in {fewer}")
    if observed["content"] != kept["content"]:
        raise ConversionFailed("values differ")
    if leading_zero_column and not kept["zeros"]:
        warnings.warn(
            f"no {leading_zero_column} starts with 0; was it read as a number?", stacklevel=3
        )
    return {"rows": kept["rows"], "columns": len(written.columns), "leading_zeros": kept["zeros"]}


def ensure_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    pins: Sequence[str] = schema.IDENTIFIER_COLUMNS,
    **options,
) -> bool:
    """Convert only if a complete store is not there yet; True when it was built now.

    A folder without the marker of a finished write is not one and is replaced. ``options`` are
    those of ``convert_csv``.
    """
    if is_complete(spark, target):
        return False
    convert_csv(spark, source, target, pins, **{**options, "overwrite": True})
    return True
