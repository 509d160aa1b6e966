"""Connected components of an edge table by contraction.

Every round hooks each component onto its smallest neighbour, follows the hooks to their roots by
pointer doubling, relabels the edges with the roots and drops the loops.  Every component with a
neighbour is merged with at least one other, so their number halves at least: the rounds are
logarithmic in the number of nodes.  All steps are joins and hash aggregates on edge rows; nothing
is collected.  A node with very many edges only ever meets map-side combined minima and joins that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, root) hooks that lead to ever smaller nodes."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        doubled = written(hooks.join(up, "root", "left").select(
            "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
        hooks = doubled.select("node", "root")
        if doubled.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b) of longs.

    Loops and repeated edges change nothing; a node that only has a loop is its own component.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL").distinct()
    edges = written(edges, "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
                     .withColumn("component", F.col("node")), "labels")
    left = edges.where("a <> b")
    while not left.isEmpty():
        roots = _roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        moved = roots.select(F.col("node").alias("component"), "root")
        labels = written(labels.join(moved, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "labels")
        for end in ("a", "b"):
            left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").select(
                F.coalesce("r", end).alias(end), "b" if end == "a" else "a")
        left = written(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "edges")
    return labels
