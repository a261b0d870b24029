"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatwise.llm.work import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is its smallest node.

    Each round points every node at its smallest neighbour, follows that pointer once more
    and replaces the ends of all edges by what they point at. Edges that have become loops
    go; the rest goes on. Rounds grow with the logarithm of a component's diameter. Edges
    and labels stay distributed and are written between rounds.
    """
    edges = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b").distinct(), "edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")) \
            .select("v", F.least("v", "m").alias("m"))
        jump = stored(
            least.alias("x").join(least.alias("y"), F.col("x.m") == F.col("y.v"))
            .select(F.col("x.v").alias("v"), F.col("y.m").alias("to")), "jump")
        labels = stored(
            labels.join(jump, F.col("label") == F.col("v"), "left")
            .select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = jump.select(F.col("v").alias("w"), F.col("to").alias("b_to"))
        edges = stored(
            edges.join(jump, F.col("a") == F.col("v")).join(ends, F.col("b") == F.col("w"))
            .where("`to` <> b_to")
            .select(F.least("to", "b_to").alias("a"), F.greatest("to", "b_to").alias("b"))
            .distinct(), "edges")
    return labels.select("node", F.col("label").alias("component"))
