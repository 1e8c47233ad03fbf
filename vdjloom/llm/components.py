"""Connected components by repeated contraction, as joins over slim edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjloom.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the ends of ``edges`` (a, b: bigint).

    Each round hooks every node to its smallest neighbour, follows one more
    hook, and contracts the edges; at least half of the nodes that still have
    edges go, so rounds grow with the logarithm of the graph.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = written(ends, "edges")
    labels = written(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn(
        "component", F.col("node")), "labels")
    while not ends.isEmpty():
        both = ends.union(ends.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("to"))
        hook = written(hook, "hooks")
        next_hook = hook.select(F.col("n").alias("to"), F.col("to").alias("_far"))
        hook = written(hook.join(next_hook, "to").select("n", F.col("_far").alias("to")), "hooks")
        labels = written(
            labels.join(hook, labels["component"] == hook["n"], "left")
            .select("node", F.coalesce("to", "component").alias("component")), "labels")
        to_a, to_b = hook.toDF("a", "x"), hook.toDF("b", "y")
        ends = written(
            ends.join(to_a, "a").join(to_b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
