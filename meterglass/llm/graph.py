"""Connected components of undirected edges by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import checkpointed


def contracted(edges: DataFrame) -> DataFrame:
    """One round on edges (u, v, v the smaller): other edges (u, v, moved) that connect the same nodes.

    Every node points to its least smaller neighbour, its other neighbours hook on to that one, and it moves on to what
    that one points to. A hub with many neighbours is one row of a partial aggregate and a skewed key of a join of
    checkpoints, which adaptive execution can split. ``moved`` is false only where a node has one edge and that one none.
    """
    points = checkpointed(nearest(edges))
    hooks = edges.join(points, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
    further = points.select(F.col("u").alias("m"), F.col("m").alias("next"))
    jumps = points.join(further, "m", "left").select("u", F.coalesce("next", "m").alias("v"), F.col("next").isNotNull().alias("moved"))
    return checkpointed(hooks.unionByName(jumps))


def directed(edges: DataFrame) -> DataFrame:
    """Edges without loops and nulls, from the greater to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the least smaller neighbour of every node that has one. Nodes of one m are connected."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns u and v): the smallest node that can be reached.

    Loops and repeated edges do no harm; rows with nulls are left out. Rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(directed(edges).withColumn("moved", F.lit(True)))
    while not now.where("moved").isEmpty():
        now = contracted(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
