"""Order-insensitive comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (0, "") if value is None else (1, type(value).__name__, value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, con, sql: str) -> list[str]:
    """Empty when column names, row counts, Python types and every value agree."""
    spark_rows = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    left, right = _canonical(frame.columns, spark_rows), _canonical(names, duck_rows)
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    return [f"{a} != {b}" for a, b in zip(left, right) if a != b][:5]
