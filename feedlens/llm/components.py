"""Connected components of a link table by alternating large and small stars.

Each round re-links every node to the smallest neighbour it knows; chains
halve, so a few rounds suffice also for long ones. A node with very many
links meets them by aggregates (combined before the shuffle) and equi-joins
of plain exchanges (which AQE splits; hence the written minima), never in one
group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import frozen


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = frozen(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return (both.filter(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = frozen(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"))
    rest = (down.join(low, F.col("a") == F.col("n")).filter(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return rest.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long, not null, a <> b) that is not the smallest of its component."""
    e = frozen(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        e = frozen(_small_star(frozen(_large_star(e))))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
