"""Platform discounts: coupon statistics and what they add to the income."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, percent, rounded
from ..operators.coupons import coupon_array, order_key, total, with_subsidy
from ..operators.scope import apply_scope
from ..schema import Scope

FLOWS = ("paid", "subsidy", "real_income")


def _per_coupon(orders: DataFrame) -> DataFrame:
    """Orders and amount per coupon.

    An order is one row and may hold a coupon twice. Its pieces are combined on the row,
    so counting orders is counting rows, and a task sends one row for each coupon.
    """
    found = F.transform(
        F.array_distinct(F.transform("_all", lambda c: c["coupon"])),
        lambda name: F.struct(name.alias("coupon"), total(
            F.filter("_all", lambda c: c["coupon"] == name)).alias("amount")))
    rows = orders.select(coupon_array().alias("_all")).select(F.inline(found))
    return rows.groupBy("coupon").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("amount").alias("_amount"))


def coupon_stats(orders: DataFrame, scope: Scope, selected: tuple[str, ...] = ()) -> DataFrame:
    out = _per_coupon(apply_scope(orders, scope))
    flag = F.col("coupon").isin(*selected) if selected else F.lit(False)
    return out.select("coupon", "n_orders", rounded(F.col("_amount"), 2).alias("amount"),
                      flag.alias("is_selected"))


def coupon_shares(orders: DataFrame, scope: Scope, selected: tuple[str, ...]) -> DataFrame:
    """Amount of each selected coupon and its share of all selected ones."""
    rows = _per_coupon(apply_scope(orders, scope)).where(F.col("coupon").isin(*selected))
    # The order counts are kept so that rows and total share one exchange.
    whole = rows.agg(F.struct(F.sum("_amount").alias("amount"), F.sum("n_orders"))).scalar()
    return rows.select(
        "coupon", "n_orders", amount(F.col("_amount")).alias("amount"),
        percent(F.col("_amount"), whole.getField("amount")).alias("share"))


def subsidy_per_order(orders: DataFrame, scope: Scope, selected: tuple[str, ...]) -> DataFrame:
    """Orders that carry a selected coupon, with its amount."""
    out = with_subsidy(apply_scope(orders, scope), selected).where(F.col("coupon_text") != "")
    return out.select(order_key().alias("order_key"), amount(F.col("subsidy")).alias("subsidy"))


def subsidy_totals(orders: DataFrame, scope: Scope, selected: tuple[str, ...]) -> DataFrame:
    rows = with_subsidy(apply_scope(orders, scope), selected)
    zero = F.lit(0)
    out = rows.agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("subsidy") > 0).alias("n_subsidised"),
        F.coalesce(F.sum("gmv"), zero).alias("_paid"),
        F.coalesce(F.sum("subsidy"), zero).alias("_subsidy"))
    uplift = F.when(F.col("_paid") > 0, percent(F.col("_subsidy"), F.col("_paid")))
    return out.select(
        "n_orders", "n_subsidised",
        rounded(F.col("_paid"), 2).alias("paid"),
        rounded(F.col("_subsidy"), 2).alias("subsidy"),
        rounded(F.col("_paid") + F.col("_subsidy"), 2).alias("real_income"),
        rounded(F.coalesce(uplift, F.lit(0.0)), 2).alias("uplift_pct"))


def subsidy_monthly(orders: DataFrame, scope: Scope, selected: tuple[str, ...]) -> DataFrame:
    rows = with_subsidy(apply_scope(orders, scope), selected)
    return rows.groupBy("order_ym").agg(
        amount(F.sum("gmv")).alias("paid"), amount(F.sum("subsidy")).alias("subsidy"),
        amount(F.sum("real_income")).alias("real_income"))


def subsidy_monthly_long(orders: DataFrame, scope: Scope, selected: tuple[str, ...]) -> DataFrame:
    return subsidy_monthly(orders, scope, selected).unpivot(
        "order_ym", list(FLOWS), "flow", "amount")


def subsidy_orders(orders: DataFrame, scope: Scope, selected: tuple[str, ...],
                   only_subsidised: bool = True, preview: int | None = None) -> DataFrame:
    """Order detail, newest first."""
    rows = with_subsidy(apply_scope(orders, scope), selected)
    if only_subsidised:
        rows = rows.where(F.col("subsidy") > 0)
    out = rows.select(
        order_key().alias("order_key"), "pay_time", "user_id", "sku", "influencer_name",
        "channel_type", "order_status", rounded(F.col("gmv"), 2).alias("paid"),
        rounded(F.col("subsidy"), 2).alias("subsidy"),
        rounded(F.col("real_income"), 2).alias("real_income"), "coupon_text", "platform_discount")
    if preview:
        return out.orderBy(F.desc("pay_time"), "order_key").limit(preview)
    return out
