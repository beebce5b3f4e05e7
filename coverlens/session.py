"""Session settings the operators rely on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tables below this many rows may be broadcast; every broadcast in the library is preceded by a
# count against it, or has a bound of its own stated at the call. The summary tables concerned
# are some 100-200 bytes wide, so this is at most about 50 MB per executor.
BROADCAST_ROWS = 250_000

# A projection of fifty coded columns compiles to one method above the 8,000 bytecodes at which
# the JVM stops compiling to machine code; without this it runs interpreted, 2-3.5 times slower.
# Clusters want the same in spark.executor.extraJavaOptions.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def local_session(name: str = "coverlens", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.extraJavaOptions": JVM_OPTIONS,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may fall back to a scratch one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach; "
                "intermediate tables are written there"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix="coverlens-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a summary table as Parquet below the shared folder and continue from the written copy.

    Used where a table is read more than once or its size decides the next step. The copy is on
    shared storage, so losing an executor costs a re-read, not a re-computation. Everything below
    the application's folder can go once the application has ended.
    """
    spark = df.sparkSession
    folder = f"{_shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = f"{folder}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
