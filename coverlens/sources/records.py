"""CSV records with line breaks in quotes, cut in parallel.

Whether a line starts a record depends on all quotes before it in the file, but only on whether their
number is even. So one pass counts the quotes of each byte range, a prefix over the ranges tells which of them
begin inside quotes, and a second pass joins lines to records range by range. A record that runs over the end
of a range comes as pieces, at most two a range, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coverlens.session import materialize

# Characters for private use; the first two that a file does not hold stand in for its line breaks.
_MARKS = [chr(0xE000 + i) for i in range(8)]
_RANGE = ["_file", "_start"]
#: Reader options under which a quote inside quotes is doubled, so that counting quotes is enough.
_UNDERSTOOD = {"header", "quote", "escape", "mode", "multiLine", "inferSchema", "samplingRatio", "nullValue", "timestampFormat", "dateFormat", "sep"}


def can_cut(options: Mapping[str, object]) -> bool:
    """Whether these reader options keep records apart by quotes alone."""
    plain = options.get("quote", '"') == '"' == options.get("escape", '"') and options.get("header")
    return bool(plain) and set(options) <= _UNDERSTOOD


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # a line keeps a carriage return at its end: it may belong to a quoted text
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    )


def _joined(breaks: str):
    """Lines of byte ranges, in order -> whole records, and pieces of those that cross a range's end."""
    names = [*_RANGE, "_piece", "_record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, headless, first = None, [], False, False

        def closed(rows: list, whole: bool) -> None:
            """End what is held: a record, or a piece of one."""
            if headless:
                rows.append((*current, 1 if whole else 2, breaks.join(held)))
            elif not whole:
                rows.append((*current, 0, breaks.join(held)))
            elif not first:  # the first record of a file names its columns
                rows.append((*current, None, breaks.join(held)))

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        inside = False
        for batch in batches:
            rows: list = []
            for value, *place, begins in zip(*[batch.column(c).to_pylist() for c in ("value", *_RANGE, "_inside")], strict=True):
                if place != current:
                    if held:
                        closed(rows, False)
                    current, held = place, []
                    inside = headless = begins
                    first = place[1] == 0
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    closed(rows, True)
                    held, headless, first = [], False, False
            yield batch_of(rows)
        rows = []
        if held:
            closed(rows, False)
        yield batch_of(rows)

    return run


def _together(pieces: DataFrame, breaks: str) -> DataFrame:
    """Pieces -> records. 0 begins one, 1 ends one, 2 is a whole range inside one."""
    order = Window.partitionBy("_file").orderBy("_start", F.col("_piece") == 0)
    chain = F.count_if(F.col("_piece") == 0).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chained = pieces.withColumn("_chain", chain).groupBy("_file", "_chain")
    parts = F.sort_array(F.collect_list(F.struct("_start", F.col("_piece") == 0, "_record")))
    found = chained.agg(parts.alias("_parts"), F.min("_start").alias("_from"))
    # the record that names the columns may itself run over a range's end
    return found.filter("_chain > 0").select(F.array_join(F.transform("_parts", lambda p: p["_record"]), breaks).alias("_record"))


def cut_records(spark: SparkSession, path: str) -> tuple[DataFrame, str] | None:
    """(records, marks): a stored table with one text per record, headers left out, line breaks as marks.

    ``marks[0]`` stands for a line feed, ``marks[1]`` for a carriage return within a record; None if a
    file holds too many of the characters that could. The header must end within its file's first range.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    ranges = lines.groupBy(*_RANGE).agg(
        (F.sum(quotes) % 2).alias("_odd"), *[F.max(F.contains("value", F.lit(m))).alias(f"_m{i}") for i, m in enumerate(_MARKS)]
    )
    ranges = materialize(ranges)  # a row per byte range: as many as the driver has scheduled
    seen = ranges.agg(*[F.max(f"_m{i}") for i in range(len(_MARKS))]).first()
    free = [m for m, found in zip(_MARKS, seen, strict=True) if not found][:2]
    if len(free) < 2:
        return None
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2 == 1
    begins = ranges.select(*[F.col(c).alias(f"_r{c}") for c in _RANGE], inside.alias("_inside"))
    match = (F.col("_file") == F.col("_r_file")) & (F.col("_start") == F.col("_r_start"))
    told = lines.join(F.broadcast(begins), match).select("value", *_RANGE, "_inside")
    schema = "_file string, _start long, _piece int, _record string"
    found = materialize(told.mapInArrow(_joined(free[0]), schema))
    records = found.filter("_piece IS NULL").select("_record")
    records = records.unionByName(_together(found.filter("_piece IS NOT NULL"), free[0]))
    # the carriage return that ends a record goes; one within it is kept apart from line ends
    record = F.regexp_replace("_record", "\r$", "")
    return records.select(F.translate(record, "\r", free[1]).alias("value")), "".join(free)


def read_cut(
    spark: SparkSession,
    path: str,
    options: Mapping[str, object],
    schema: StructType | None = None,
    cut: tuple[DataFrame, str] | None = None,
) -> DataFrame | None:
    """The table of a CSV whose quoted texts may hold line breaks, read by as many tasks as it has ranges.

    Equal to Spark's own reader with ``multiLine``, which reads a file in one task, but for the order
    of the records that cross a range's end; and line ends within quotes stay as they are, while that
    reader turns CR LF into LF where lines end so. None if the file cannot be cut. ``cut`` passes on
    the result of ``cut_records``, for a second reading.
    """
    cut = cut or cut_records(spark, path)
    if cut is None:
        return None
    records, marks = cut
    names = spark.read.options(**{**options, "inferSchema": False, "multiLine": True}).csv(path).columns
    reader = spark.read.options(**{**options, "header": False, "multiLine": False})
    if schema is None and records.isEmpty():  # nothing to infer from
        schema = StructType([StructField(name, StringType()) for name in names])
    if schema is not None:
        reader = reader.schema(schema)
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    parsed = DataFrame(reader._jreader.csv(texts), spark).toDF(*(names if schema is None else schema.names))

    def restored(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return F.translate(column, marks, "\n\r").alias(name) if kind == "string" else column

    return parsed.select(*[restored(f.name, f.dataType.simpleString()) for f in parsed.schema])
