"""Connected components of an edge table by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of an edge.

    Each round points every node to its least neighbour (pre-aggregated, so a hub's edges needn't meet),
    follows those pointers twice, and replaces edges by the edges between the nodes pointed to, which
    leaves out all within a group: edges shrink by half at least. Rounds are written to the shared folder.
    """
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialise(ends.select("node", F.col("node").alias("component")), "labels")
    for _ in range(ROUNDS):
        if not left.limit(1).count():
            return labels
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        near = both.groupBy("e.u").agg(F.min("e.v").alias("m")).select("u", F.least("u", "m").alias("root"))
        near = materialise(near, "pointers")
        for _ in range(2):
            on = near.select(F.col("u").alias("p"), F.col("root").alias("further"))
            near = near.join(on, near.root == on.p).select("u", F.col("further").alias("root"))
        near = materialise(near, "pointers")
        at_a, at_b = near.select(F.col("u").alias("a"), F.col("root").alias("x")), near.select(F.col("u").alias("b"), F.col("root").alias("y"))
        left = materialise(left.join(at_a, "a").join(at_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
        moved = near.withColumnRenamed("u", "component")
        labels = materialise(labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
    raise RuntimeError("components did not settle")
