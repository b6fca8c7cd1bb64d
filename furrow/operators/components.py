"""Connected components of an edge table by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage


def _moved(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    step = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = df.join(step, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater node to the smaller one, without loops."""
    a, b = F.col("a"), F.col("b")
    turned = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    return turned.distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node of ``edges(a, b)``: node, root. Nodes of any ordered type.

    Every node hooks to its smallest smaller neighbour; the trees are flattened by following parents of
    parents, and edges are drawn between the roots. A component halves its roots at least each time, a tree its height.
    Minima are taken before the shuffle, and all steps are written to the checkpoint folder.
    """
    left = cut_lineage(_downhill(edges))
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = cut_lineage(nodes.withColumn("root", F.col("node")))
    while not left.isEmpty():
        parents = cut_lineage(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        while True:
            higher = _moved(parents.withColumn("_was", F.col("root")), "root", parents)
            moved: Column = F.count_if(F.col("root") != F.col("_was"))
            higher = cut_lineage(higher)
            if not higher.agg(moved.alias("n")).first()["n"]:
                break
            parents = higher.drop("_was")
        roots = cut_lineage(_moved(roots, "root", parents))
        left = cut_lineage(_downhill(_moved(_moved(left, "a", parents), "b", parents)))
    return roots
