"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Links that a task writes: a step takes as many tasks as its links need, not as many as the session shuffles to.
LINKS_A_TASK = 100_000


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Link every neighbour of a node (the larger, or the smaller and itself) to the node's smallest neighbour."""
    # written, so that the join below reads two plain shuffles and can split a star with very many leaves
    least = durable(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
    near = pairs.where(F.col("b") > F.col("a")) if large else pairs.where(F.col("b") < F.col("a"))
    moved = near.join(least, "a").select(F.col("b").alias("x"), "m")
    if not large:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where(F.col("x") != F.col("m")).select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct().coalesce(tasks)


def _settled(links: DataFrame, tasks: int) -> bool:
    """Whether every node has one link to a smaller one or links to larger ones only: further steps would change nothing."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks)
    return ends.where("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the smallest node of the component.

    Every round writes the links as a table, which cuts the lineage; there are about
    as many rounds as the logarithm of the longest path, in tasks by the number of links. A star with very many leaves is
    summed before the shuffle, and its join is one that adaptive execution can split.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = durable(links)
    while True:
        tasks = 1 + links.count() // LINKS_A_TASK
        large = durable(_star(_both(links), True, tasks))
        links = durable(_star(large, False, tasks))
        if _settled(links, tasks):
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
