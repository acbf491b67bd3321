"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    larger = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge (a, b); a component is named by its least id.

    Edges are longs without nulls; loops and repeated edges do not matter. Both kinds of star combine
    on the map side, so a node with very many neighbours is a few rows per task; its join is an ordinary one
    that the engine can split. Rounds grow with the logarithm of the longest chain; each is written out.
    """
    down = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, before = kept(down.distinct(), "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                current.select("b", F.col("b").alias("component")).distinct().toDF("id", "component")
            )
        before = state
        current = kept(_small_star(_large_star(current).distinct()).distinct(), "edges")
