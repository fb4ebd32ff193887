"""Connected components of a distributed edge list, by hooking to the smallest neighbour and contracting.

Each round gives every node its smallest neighbour (if smaller) as parent, follows parents to their roots by pointer
jumping, and replaces both ends of every edge by their roots; edges inside a tree vanish.  The number of nodes at least
halves in each part that still has an edge, so rounds grow with the logarithm of the input.  Edges and labels are cut
from their lineage by checkpoint() in the shared folder, so a lost executor costs a re-read, and none is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.texts import checkpoint


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of parent pointers that only ever lead to smaller nodes; a node absent from `node` is a root."""
    jumped = checkpoint(parents.where("root < node"))
    while True:
        up = jumped.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = checkpoint(jumped.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumped = after.select("node", "root")
        if after.where("moved").isEmpty():
            return jumped


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b) that is not its component's smallest: that smallest node."""
    left = checkpoint(_pairs(edges))
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("root")))
        roots = _roots(both.groupBy("node").agg(F.min("root").alias("root")))
        if labels is None:
            labels = roots
        else:
            later = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = moved.unionByName(roots)
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(at_a, "a", "left").join(at_b, "b", "left")
        left = checkpoint(_pairs(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return checkpoint(labels.select("node", F.col("root").alias("component")).distinct())
