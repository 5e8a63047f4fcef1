"""Connected components by alternating large and small stars over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("high <> low").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.withColumn("least", F.least("node", "least"))
    upper = both.where("other > node").join(least, "node")
    return _distinct(upper.select(F.col("other").alias("high"), F.col("least").alias("low")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    lower = edges.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return _distinct(lower.unionByName(least.select("high", F.col("least").alias("low"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its own root; root is the smallest node reachable.

    Links may be given in either direction and more than once. Each round reads and writes one table of
    edges; the number of rounds grows with the logarithm of the longest chain. A hub with many links is
    summed before the shuffle, and the join that sends its minimum back can be split.
    """
    edges = stored(_distinct(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))))
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
        seen = now
        edges = stored(_small_star(_large_star(edges)))
