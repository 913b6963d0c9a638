"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import checkpoint

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``edges`` (a, b: long).

    Each round every node points to its smallest neighbour or itself, pointers are followed once more, and the
    graph is contracted to the nodes pointed to; the number of nodes with edges at least halves. A hub is
    one aggregated row per task, never a list. Loops, repeated and null edges are harmless. Every round is
    written to the shared folder, so a lost executor costs one round.
    """
    edges = checkpoint(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = checkpoint(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            return labels
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = checkpoint(parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("q")), "jumps")
        of = lambda name: jump.select(F.col("a").alias(name), F.col("q").alias(f"{name}_to"))
        labels = checkpoint(labels.join(of("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), "labels")
        moved = edges.join(of("a"), "a").join(of("b"), "b").filter("a_to <> b_to")
        edges = checkpoint(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
