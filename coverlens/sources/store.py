"""Finished folders on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MARKER = "_SUCCESS"


def _place(spark: SparkSession, path: str):
    """A path and its file system, by Spark's own Hadoop client."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def is_complete(spark: SparkSession, path: str) -> bool:
    """The folder was committed by a finished write."""
    return exists(spark, f"{path.rstrip('/')}/{MARKER}")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of ``target``.

    What is there is set aside, not deleted, until the new folder has its place, and put back if
    that fails; a crash between the two leaves both folders whole, under other names.
    """
    if not is_complete(spark, source):
        raise FileNotFoundError(f"{source} is not a finished folder")
    old, files = _place(spark, target)
    new, _ = _place(spark, source)
    aside, _ = _place(spark, f"{target.rstrip('/')}-replaced-{uuid.uuid4().hex[:12]}")
    replaced = files.exists(old)
    if replaced and not files.rename(old, aside):
        raise OSError(f"cannot set {target} aside")
    if files.exists(old) or not files.rename(new, old):
        if replaced and not files.exists(old):
            files.rename(aside, old)
        raise OSError(f"cannot move {source} to {target}")
    if replaced:
        files.delete(aside, True)
