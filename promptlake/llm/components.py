"""Connected components by contraction: every round hooks each node to its smallest neighbour.

Edges, nodes and labels stay distributed; a round is a few joins and partial aggregations, so a
node with very many edges costs one row per task. Each round at least halves the nodes that still
have edges, and writes its tables to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node reachable, for every node with an edge.

    Self loops, repeated edges and either direction are allowed; null ends are left out."""
    cols = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b and a is not null and b is not null").distinct()
    todo = cut_lineage(cols, "edges")
    hooks: list[DataFrame] = []
    while todo.limit(1).count():
        both = todo.select(F.col("a").alias("node"), F.col("b").alias("near")).union(todo.select("b", "a"))
        parent = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))
        parent = cut_lineage(parent, "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parent = cut_lineage(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "hooks")
        hooks.append(parent)
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = todo.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        todo = cut_lineage(moved.where("a < b").distinct(), "edges")
    if not hooks:
        return todo.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = hooks[0].withColumnRenamed("parent", "component")
    for h in hooks[1:]:
        labels = labels.join(h.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return cut_lineage(labels, "components")
