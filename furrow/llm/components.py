"""Connected components of a graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges(a, b)``: node, root.

    Each round links the larger neighbours of every node to its smallest neighbour, then its smaller ones, and
    writes the edges to the checkpoint folder; only their number and hash go to the driver. Minima are
    aggregated before the shuffle, and the joins are plain ones that adaptive execution can split, so a node with
    very many links is no single task. Loops and repeated edges do no harm; nodes without edges are not returned.
    """
    edges = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
