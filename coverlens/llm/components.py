"""Connected components of a link table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import written


def _toward_least(links: DataFrame, least: DataFrame) -> DataFrame:
    # A hub's rows meet one row of `least`; adaptive execution splits such a partition.
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return _toward_least(both.where("b > a"), least).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = _toward_least(links, least).where("a <> b")
    return moved.union(least.toDF("a", "b")).distinct()


def _signature(links: DataFrame) -> tuple:
    # Sums of 32-bit parts cannot overflow for fewer than 2^31 links a partition.
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) links -> (node, root): every linked node but the roots, root the least node.

    Loops, repeated and turned links are allowed; no links give no rows. Every round is written to
    the shared folder. The number of rounds grows with the logarithm of the largest component.
    """
    links = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    links = written(links, "links")
    before = _signature(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), "links")
        now = _signature(links)
        if now == before:
            break
        before = now
    return links.toDF("node", "root")
