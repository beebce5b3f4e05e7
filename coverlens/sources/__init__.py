"""Reading, converting and writing."""

from coverlens.sources.ingest import ConversionFailed, convert_csv, ensure_parquet, pinned_schema
from coverlens.sources.parquet import describe, describe_stored, load, with_row_position
from coverlens.sources.records import read_cut
from coverlens.sources.sinks import write_csv_report, write_ordered, write_parquet

__all__ = [
    "ConversionFailed",
    "convert_csv",
    "describe",
    "describe_stored",
    "ensure_parquet",
    "load",
    "pinned_schema",
    "read_cut",
    "with_row_position",
    "write_csv_report",
    "write_ordered",
    "write_parquet",
]
