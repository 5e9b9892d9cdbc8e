"""Connected components of a graph of long ids by alternating large and small stars.

All steps are joins and partial aggregations; tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import removed, written


def _starred(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node (all, or the smaller ones) on the smallest of them and the node."""
    if both_ways:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = near.join(least, "u")
    if both_ways:
        moved = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """(node, root) for each node of ``edges`` (a, b) that isn't its component's smallest; and the folders used.

    Stops when a round changes nothing. Self-links and repeated edges have no effect.
    """
    spark = edges.sparkSession
    now, path = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        after, next_path = written(_starred(_starred(now, True), False), "edges")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(spark, path)
        now, path = after, next_path
        if sums == before or sums[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")), [path]
        before = sums
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
