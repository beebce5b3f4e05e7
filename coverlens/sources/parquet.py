"""Parquet input: views, row positions, schema listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlens.operators.lookup import lookup_join

# One entry per input file; the driver already holds the file listing.
FILE_TABLE_ROWS = 500_000


def with_row_position(spark: SparkSession, path: str, name: str = "tts_row") -> DataFrame:
    """Rows of a Parquet file or folder with their 1-based position, files in path order.

    The position is a property of the stored file: filters and re-reads do not change it.
    """
    rows = spark.read.parquet(path)
    columns = rows.columns
    rows = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")
    )
    if len(rows.inputFiles()) <= 1:
        return rows.select(*columns, (F.col("_index") + 1).alias(name))
    # needs no data column, so only footers and row indexes are read
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    rows = lookup_join(
        rows,
        files,
        ["_file"],
        weight="_rows",
        broadcast_rows=FILE_TABLE_ROWS,
    )
    return rows.select(*columns, (F.col("_offset") + F.col("_index") + 1).alias(name))


def load(spark: SparkSession, path: str, view: str | None = None, position: str | None = "tts_row") -> DataFrame:
    """Open the stored table, optionally with row positions and registered as a view."""
    df = with_row_position(spark, path, position) if position else spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def _counts(df: DataFrame) -> DataFrame:
    """One row: how many rows carry a non-NULL value, for each column."""
    return df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema)])


def describe(df: DataFrame) -> DataFrame:
    """The schema as a table, with how many rows carry a non-NULL value."""
    counted = _counts(df)
    listing = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("long").alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.col(f"c{i}").alias("non_null_rows"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counted.select(F.explode(listing).alias("c")).select("c.*")


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """`_counts` of a stored table, from the statistics of its row groups.

    Spark takes them from the files' footers where its aggregate is pushed to the Parquet reader,
    which a session of its own is set to do.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _counts(own.read.parquet(path))


def describe_stored(spark: SparkSession, path: str) -> DataFrame:
    """`describe` of a stored table without reading its columns; they are read where a footer lacks the counts."""
    stored = spark.read.parquet(path)
    try:
        counted = footer_counts(spark, path).first()
    except Exception as error:  # noqa: BLE001 - Spark names the missing statistics in the text alone
        if "parquet.aggregatePushdown" not in str(error):
            raise
        return describe(stored)
    rows = [(i + 1, f.name, f.dataType.simpleString(), counted[i]) for i, f in enumerate(stored.schema)]
    return spark.createDataFrame(rows, "ordinal long, column_name string, column_type string, non_null_rows long")
