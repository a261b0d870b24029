"""Members: new against old ones, and members against everyone else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import per, percent, rounded
from ..operators.scope import apply_scope
from ..schema import DateRange, Scope, Tables


def _per_user(orders: DataFrame, scope: Scope) -> DataFrame:
    return apply_scope(orders, scope).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("gmv").alias("_gmv"))


def member_kinds(members: DataFrame, window: DateRange | None = None) -> DataFrame:
    """Members marked new if they joined in the window, else old.

    Without a window: the 365 days up to the latest join, not before the first one.
    """
    day = F.col("join_time").cast("date")
    if window:
        first, last = F.lit(window[0]), F.lit(window[1])
    else:
        ends = members.agg(F.struct(F.min("join_time").cast("date").alias("lo"),
                                    F.max("join_time").cast("date").alias("hi"))).scalar()
        last = ends.getField("hi")
        first = F.greatest(ends.getField("lo"), F.date_sub(last, 365))
    new = F.coalesce(day.between(first, last), F.lit(False))
    return members.withColumn("member_type", F.when(new, "new").otherwise("old"))


def _with_orders(t: Tables, scope: Scope, window: DateRange | None) -> DataFrame:
    kinds = member_kinds(t.need("members"), window)
    return kinds.join(_per_user(t.orders, scope), "user_id", "left")


def member_kpi(t: Tables, scope: Scope, window: DateRange | None = None) -> DataFrame:
    out = _with_orders(t, scope, window).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col("member_type") == "new").alias("new_members"),
        F.count_if(F.col("member_type") == "old").alias("old_members"),
        F.count("_orders").alias("buying_members"))
    return out.withColumn("conversion", per(F.col("buying_members"), F.col("members")))


def member_compare(t: Tables, scope: Scope, window: DateRange | None = None) -> DataFrame:
    """New and old members: size, buyers, orders, amount, conversion, per buyer.

    Both kinds have a row, also without members.
    """
    zero = F.lit(0)
    found = _with_orders(t, scope, window).groupBy("member_type").agg(
        F.count(F.lit(1)).alias("members"), F.count("_orders").alias("buyers"),
        F.sum("_orders").alias("orders"), F.sum("_gmv").alias("_total"))
    kinds = found.sparkSession.createDataFrame([("new",), ("old",)], "member_type string")
    out = kinds.join(found, "member_type", "left").select(
        "member_type", *(F.coalesce(c, zero).alias(c) for c in ("members", "buyers", "orders", "_total")))
    return out.select(
        "member_type", "members", "buyers", "orders", rounded(F.col("_total"), 0).alias("gmv"),
        rounded(percent(F.col("buyers"), F.col("members")), 2).alias("conversion_pct"),
        F.when(F.col("buyers") > 0, rounded(per(F.col("_total"), F.col("buyers")), 0))
        .otherwise(F.lit(0.0)).alias("per_buyer"))


def member_joins(members: DataFrame) -> DataFrame:
    """Joins per month; a member is one row."""
    return members.where(F.col("join_time").isNotNull()).groupBy("join_ym").agg(
        F.count(F.lit(1)).alias("joined"))


def _by_membership(t: Tables, scope: Scope) -> DataFrame:
    members = t.need("members").select("user_id", F.lit(True).alias("_member"))
    rows = _per_user(t.orders, scope).join(members, "user_id", "left")
    return rows.groupBy(F.coalesce("_member", F.lit(False)).alias("is_member")).agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("_orders").alias("orders"),
        F.sum("_gmv").alias("_total"))


def member_vs_non(t: Tables, scope: Scope) -> DataFrame:
    return _by_membership(t, scope).select(
        "is_member", "buyers", "orders", rounded(F.col("_total"), 0).alias("gmv"),
        rounded(per(F.col("_total"), F.col("buyers")), 0).alias("per_buyer"),
        rounded(per(F.col("orders"), F.col("buyers")), 2).alias("frequency"))


def member_share(t: Tables, scope: Scope) -> DataFrame:
    """Members' share of buyers and of the amount, in percent."""
    member = F.col("is_member")
    pick = lambda c: F.coalesce(F.sum(F.when(member, F.col(c))), F.lit(0))
    out = _by_membership(t, scope).agg(
        pick("buyers").alias("_b"), F.sum("buyers").alias("_all_b"),
        pick("_total").alias("_g"), F.sum("_total").alias("_all_g"))
    return out.select(percent(F.col("_b"), F.col("_all_b")).alias("buyer_share"),
                      percent(F.col("_g"), F.col("_all_g")).alias("gmv_share"))
