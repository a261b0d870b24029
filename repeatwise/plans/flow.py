"""Flow of users between influencers from one purchase to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import percent, rounded
from ..operators.scope import apply_scope, scope_pairs
from ..schema import Scope, Tables


def flow_links(t: Tables, scope: Scope, max_rank: int = 4, min_count: int = 3) -> DataFrame:
    """Links between (rank, influencer) nodes with conversion out of the source.

    The source total adds up the links shown, that is after `min_count`.
    """
    users = apply_scope(t.orders, scope).select("user_id").distinct()
    # The rank bound leaves at most max_rank - 1 pairs per user.
    moves = scope_pairs(t.pairs, scope).where(F.col("from_rank") <= max_rank - 1)
    node = lambda side: F.concat_ws("|", F.col(f"{side}_rank").cast("string"),
                                    F.col(f"{side}_influencer"))
    links = (
        moves.join(users, "user_id", "left_semi")
        .groupBy(node("from").alias("source"), node("to").alias("target"))
        .agg(F.count(F.lit(1)).alias("n_moves"))
        .where(F.col("n_moves") >= min_count)
    )
    return (
        links.withColumn("source_total", F.sum("n_moves").over(W.partitionBy("source")))
        .withColumn("conversion", rounded(percent(F.col("n_moves"), F.col("source_total")), 1))
    )


def flow_nodes(t: Tables, scope: Scope, max_rank: int = 4, min_count: int = 3) -> DataFrame:
    """Every node of the links with the moves leaving it, zero at the end of a path."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("n_moves").alias("n")),
        F.struct(F.col("target").alias("node"), F.lit(0).cast("long").alias("n")))
    links = flow_links(t, scope, max_rank, min_count)
    return links.select(F.inline(ends)).groupBy("node").agg(F.sum("n").alias("out_flow"))
