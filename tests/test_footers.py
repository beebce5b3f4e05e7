"""The profile of a stored table comes from the files' footers."""

from pyspark.sql import functions as F

from coverlens.sources import describe, describe_stored
from coverlens.sources.parquet import footer_counts


def test_profile_without_reading_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).select(
        F.col("id").alias("a.b"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"),
        F.lit(None).cast("date").alias("never"),
        F.when(F.col("id") < 10, F.col("id") / 3).alias("few"),
    )
    rows.repartition(3).write.parquet(path)
    plan = footer_counts(spark, path)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedAggregation: [COUNT(" in plan
    assert describe_stored(spark, path).collect() == describe(spark.read.parquet(path)).collect()


def test_footers_without_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.when(F.col("id") > 4, F.col("id")).alias("a"))
    rows.write.option("parquet.column.statistics.enabled", "false").parquet(path)
    assert [tuple(r) for r in describe_stored(spark, path).collect()] == [(1, "a", "bigint", 95)]
    assert describe_stored(spark, path).schema.names == describe(spark.read.parquet(path)).schema.names
