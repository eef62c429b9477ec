"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b: long); comp is a node of the component, the same for all its nodes.

    Each round hooks every node to its least neighbour, follows the hooks to their roots, and contracts; edges at least halve in
    effect, so rounds grow with the logarithm of the size. Nothing is collected; each round is cut by a checkpoint.
    """
    edges = settle(edges.select("a", "b").filter("a != b").distinct())
    labels = settle(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        while True:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            jumped = settle(hook.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"), (F.coalesce("top", "parent") != F.col("parent")).alias("moved")))
            hook = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        root = hook.select(F.col("node").alias("comp"), F.col("parent").alias("root"))
        labels = settle(labels.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("parent").alias("ra")), "a", "left")
        both_ends = left.join(hook.select(F.col("node").alias("b"), F.col("parent").alias("rb")), "b", "left")
        edges = settle(both_ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a != b").distinct())
    return labels
