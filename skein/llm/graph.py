"""Connected components of an edge table, by alternating large-star and small-star.

Kiveris et al., "Connected components in MapReduce and beyond" (2014). Each round
is a few joins and groupings of the edges; the number of rounds grows with the
logarithm of the longest path. Edges, never nodes without edges, are held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import forget, fresh_path, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One pass: join each node's neighbours to the least of them and the node itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
    least = both.groupBy("b").agg(F.min("a").alias("least")).select(F.col("b").alias("node"), F.least("b", "least").alias("least"))
    joined = both.join(least, both["b"] == least["node"])
    if small:  # b's lower neighbours and b itself go to the least
        moved = joined.select("a", "least").unionByName(least.select(F.col("node").alias("a"), "least"))
    else:  # neighbours above the node go to the least
        moved = joined.where(F.col("a") > F.col("b")).select("a", "least")
    return moved.where(F.col("a") != F.col("least")).select(F.col("least").alias("a"), F.col("a").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Loops and repeated edges are harmless; rows with a null end are ignored. No edges give no rows.
    """
    held = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct()
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    held = written(held, path=path)
    before = None
    for _ in range(rounds):
        last, path = path, fresh_path(spark, "edges")
        held = written(_star(_star(held, small=False), small=True), path=path)
        forget(spark, last)
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return held.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(held.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
