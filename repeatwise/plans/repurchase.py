"""Repurchase cycles, rates and destinations.

Every report restricts pairs to certain users. Pairs are combined per user and
report key first, so a user with very many pairs brings few rows to that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import is_new, is_returning, one_of, percent, rounded
from ..operators.people import distinct_users, of_users
from ..operators.scope import apply_scope, scope_pairs
from ..schema import Scope, Tables

# Report dimension -> (column of orders, first and second column of pairs).
BY = {
    "influencer": ("influencer_name", "from_influencer", "to_influencer"),
    "sku": ("sku", "from_sku", "to_sku"),
}


def repurchase_cycle(t: Tables, scope: Scope, by: str = "influencer", min_count: int = 5,
                     min_gap_days: int = 0, align_scope: bool = False) -> DataFrame:
    """Average days between consecutive orders per pair of values.

    Counts pairs of users with a returning order in scope; rarer moves than
    `min_count` are left out.
    """
    _, from_col, to_col = BY[by]
    users = distinct_users(apply_scope(t.orders, scope).where(is_returning()))
    moves = (
        scope_pairs(t.pairs, scope, align_scope).where(F.col("days_between") >= min_gap_days)
        .groupBy("user_id", from_col, to_col)
        .agg(F.sum("days_between").alias("_days"), F.count(F.lit(1)).alias("_n"))
    )
    cycle = of_users(moves, users).groupBy(from_col, to_col).agg(
        F.sum("_days").alias("_days"), F.sum("_n").alias("n_moves"))
    return cycle.where(F.col("n_moves") >= min_count).select(
        from_col, to_col,
        (F.col("_days").cast("double") / F.col("n_moves").cast("double")).alias("avg_days"),
        "n_moves")


def repurchase_cycle_rows(t: Tables, scope: Scope, by: str = "sku", min_count: int = 5) -> DataFrame:
    """The matrix of average days as sparse rows, for any number of values.

    `avg_days` maps each second value that occurs to its days. A row holds as many entries as
    there are values at most, and no job has to find out about columns.
    """
    _, from_col, to_col = BY[by]
    cell = F.struct(F.col(to_col), rounded(F.col("avg_days"), 1))
    return repurchase_cycle(t, scope, by, min_count).groupBy(from_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("avg_days"))


def repurchase_cycle_matrix(t: Tables, scope: Scope, values: list[str] | None = None,
                            by: str = "sku", min_count: int = 5) -> DataFrame:
    """Average days with the second values as columns.

    Without `values` every value that occurs gets a column, which takes a job to find out; beyond
    some thousand values `repurchase_cycle_rows` is what to use.
    """
    rows = repurchase_cycle_rows(t, scope, by, min_count)
    if values is None:
        found = rows.select(F.explode(F.map_keys("avg_days")).alias("value")).distinct()
        values = [r.value for r in found.orderBy("value").collect()]
    return rows.select(BY[by][1], *[F.try_element_at("avg_days", F.lit(v)).alias(v) for v in values])


def _entry(t: Tables, scope: Scope, by: str, first: tuple[str, ...], channel: str | None,
           entry: str) -> DataFrame:
    """Orders that bring a user into the count."""
    column = BY[by][0]
    rows = apply_scope(t.orders, scope)
    rows = rows.where(is_new() if entry == "label" else F.col("purchase_rank") == 1)
    if channel:
        rows = rows.where(F.col("channel_type") == channel)
    return rows.where(one_of(column, first)) if first else rows


def _repeats(t: Tables, scope: Scope, by: str, first: tuple[str, ...], channel: str | None,
             entry: str, min_gap_days: int, align_scope: bool) -> DataFrame:
    """Pairs that start with such an order."""
    column = BY[by][1]
    rows = scope_pairs(t.pairs, scope, align_scope)
    rows = rows.where(is_new() if entry == "label" else F.col("from_rank") == 1)
    rows = rows.where(F.col("days_between") >= min_gap_days)
    if channel:
        rows = rows.where(F.col("from_channel_type") == channel)
    return rows.where(one_of(column, first)) if first else rows


def repurchase_rate(t: Tables, scope: Scope, by: str = "influencer", first: tuple[str, ...] = (),
                    channel: str | None = None, entry: str = "label", min_gap_days: int = 0,
                    align_scope: bool = False) -> DataFrame:
    """Users entering in scope, those of them who bought again, and the rate."""
    users = distinct_users(_entry(t, scope, by, first, channel, entry))
    again = distinct_users(
        _repeats(t, scope, by, first, channel, entry, min_gap_days, align_scope))
    both = users.join(again.withColumn("_again", F.lit(1)), "user_id", "left")
    out = both.agg(F.count(F.lit(1)).alias("entry_users"), F.count("_again").alias("repeat_users"))
    return out.withColumn("rate", percent(F.col("repeat_users"), F.col("entry_users")))


def repurchase_destinations(t: Tables, scope: Scope, by: str = "influencer",
                            first: tuple[str, ...] = (), channel: str | None = None,
                            entry: str = "label", min_gap_days: int = 0,
                            align_scope: bool = False) -> DataFrame:
    """Where the next order went: moves, users and their share of entry users."""
    to_col = BY[by][2]
    users = distinct_users(_entry(t, scope, by, first, channel, entry))
    per_user = (
        _repeats(t, scope, by, first, channel, entry, min_gap_days, align_scope)
        .groupBy("user_id", to_col).agg(F.count(F.lit(1)).alias("_n"))
    )
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = of_users(per_user, users).groupBy(to_col).agg(
        F.sum("_n").alias("n_moves"), F.count(F.lit(1)).alias("repeat_users"))
    return out.withColumn("rate", rounded(percent(F.col("repeat_users"), total), 2)).orderBy(
        F.desc("n_moves"), to_col)


def repurchase_by_channel(t: Tables, scope: Scope, first: tuple[str, ...] = (),
                          channel: str | None = None, entry: str = "label") -> DataFrame:
    """Destinations per channel type and, below it, per influencer.

    Rows of a channel type have no influencer; its users are counted once there,
    however many of its influencers they went to.
    """
    users = distinct_users(_entry(t, scope, "influencer", first, channel, entry))
    rows = _repeats(t, scope, "influencer", first, channel, entry, 0, False)
    grains = ["to_channel_type", "to_influencer", "user_id"]
    per_user = (
        rows.groupingSets([grains, ["to_channel_type", "user_id"]], *grains)
        .agg(F.grouping("to_influencer").alias("_whole"), F.count(F.lit(1)).alias("_n"))
    )
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = of_users(per_user, users).groupBy("_whole", "to_channel_type", "to_influencer").agg(
        F.sum("_n").alias("n_moves"), F.count(F.lit(1)).alias("repeat_users"))
    return out.select(
        F.when(F.col("_whole") == 1, "channel").otherwise("influencer").alias("level"),
        "to_channel_type", "to_influencer", "n_moves", "repeat_users",
        rounded(percent(F.col("repeat_users"), total), 2).alias("rate"))


def repurchase_monthly(t: Tables, scope: Scope, by: str = "influencer",
                       first: tuple[str, ...] = (), channel: str | None = None,
                       entry: str = "label") -> DataFrame:
    """Rate per entry month and its change from the month before.

    A user entering in several months counts in each of them.
    """
    users = _entry(t, scope, by, first, channel, entry).select("user_id", "order_ym").distinct()
    again = distinct_users(_repeats(t, scope, by, first, channel, entry, 0, False))
    months = (
        users.join(again.withColumn("_again", F.lit(1)), "user_id", "left")
        .groupBy("order_ym")
        .agg(F.count(F.lit(1)).alias("entry_users"), F.count("_again").alias("repeat_users"))
        .withColumn("rate", rounded(percent(F.col("repeat_users"), F.col("entry_users")), 2))
    )
    # One row per calendar month: few enough for an unpartitioned window.
    before = F.lag("rate").over(W.orderBy("order_ym"))
    return months.withColumn("rate_change", rounded(F.col("rate") - before, 2))


def repurchase_intervals(t: Tables, scope: Scope, channel: str | None = None,
                         bins: int = 30) -> DataFrame:
    """Histogram of the days from the first to the second order, in equal bins."""
    firsts = apply_scope(t.orders, scope).where(F.col("purchase_rank") == 1)
    rows = scope_pairs(t.pairs, scope).where(F.col("from_rank") == 1)
    if channel:
        firsts = firsts.where(F.col("channel_type") == channel)
        rows = rows.where(F.col("from_channel_type") == channel)
    # A user has one first order and at most one pair starting there.
    days = (
        rows.select("user_id", "days_between").join(firsts.select("user_id"), "user_id", "left_semi")
        .groupBy("days_between").agg(F.count(F.lit(1)).alias("_n"))
    )
    span = days.agg(F.struct(F.min("days_between").alias("lo"), F.max("days_between").alias("hi"),
                             F.sum("_n").alias("n"))).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = F.when(hi == lo, F.lit(1)).otherwise(hi - lo)
    place = F.floor((F.col("days_between") - lo) * bins / width).cast("long")
    return (
        days.withColumn("bin", F.least(place, F.lit(bins - 1).cast("long")))
        .groupBy("bin").agg(F.sum("_n").alias("n_pairs"), F.min("days_between").alias("min_days"),
                            F.max("days_between").alias("max_days"))
    )
