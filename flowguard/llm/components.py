"""Connected components of links in Spark: least reachable node by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowguard.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); root is the least node of its component.

    Each round hooks the root of a node onto the least root among its neighbours and halves the paths
    to the roots, so the rounds grow with the logarithm of the longest chain. Tables of a round are
    written to the shared folder; lost executors cost no more than one round. Sums and minima are
    pre-aggregated, so a node with very many links is no hot key.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a != b").distinct(), "components-edges")
    label = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    label = materialize(label, "components-label")
    while True:
        a = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = edges.join(a, "a").join(b, "b").where("ra > rb")
        hook = ends.groupBy("ra").agg(F.min("rb").alias("to"))
        hook = materialize(hook, "components-hook")
        if hook.isEmpty():
            return label
        # roots point to smaller roots; two jumps shorten the chains of roots
        once = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.ra"), "left")
        once = materialize(once.select(F.col("x.ra").alias("ra"), F.coalesce("y.to", "x.to").alias("to")), "components-jump")
        twice = once.alias("x").join(once.alias("y"), F.col("x.to") == F.col("y.ra"), "left")
        jump = twice.select(F.col("x.ra").alias("root"), F.coalesce("y.to", "x.to").alias("to"))
        label = label.join(jump, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        label = materialize(label, "components-label")
