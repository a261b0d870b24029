"""Uploaded audiences matched with orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, one_of, per, percent, rounded
from ..operators.people import distinct_users, of_users
from ..operators.scope import apply_scope
from ..schema import Scope, Tables

PERIODS = {"day": "order_date", "month": "order_ym"}


def _selected(t: Tables, names: tuple[str, ...]) -> DataFrame:
    crowds = t.need("crowds")
    return crowds.where(one_of("crowd_name", names)) if names else crowds


def _per_user(orders: DataFrame, scope: Scope, *keys: str) -> DataFrame:
    return apply_scope(orders, scope).groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("gmv").alias("_gmv"))


def crowd_kpi(t: Tables, scope: Scope, names: tuple[str, ...] = ()) -> DataFrame:
    """All selected audiences together; a user of several counts once."""
    users = distinct_users(_selected(t, names))
    out = users.join(_per_user(t.orders, scope), "user_id", "left").agg(
        F.count(F.lit(1)).alias("users"), F.count("_orders").alias("buyers"),
        amount(F.coalesce(F.sum("_gmv"), F.lit(0))).alias("gmv"))
    return out.select("users", "buyers",
                      percent(F.col("buyers"), F.col("users")).alias("conversion_pct"), "gmv")


def crowd_compare(t: Tables, scope: Scope, names: tuple[str, ...] = ()) -> DataFrame:
    """Per audience; a user of several counts in each."""
    zero = F.lit(0)
    out = (
        _selected(t, names).join(_per_user(t.orders, scope), "user_id", "left")
        .groupBy("crowd_name").agg(
            F.count(F.lit(1)).alias("users"), F.count("_orders").alias("buyers"),
            F.coalesce(F.sum("_orders"), zero).alias("orders"),
            F.coalesce(F.sum("_gmv"), zero).alias("_total"))
    )
    return out.select(
        "crowd_name", "users", "buyers",
        rounded(percent(F.col("buyers"), F.col("users")), 2).alias("conversion_pct"),
        "orders", rounded(F.col("_total"), 0).alias("gmv"),
        F.when(F.col("buyers") > 0, rounded(per(F.col("_total"), F.col("buyers")), 0))
        .otherwise(F.lit(0.0)).alias("per_buyer"))


def _bought(t: Tables, scope: Scope, names: tuple[str, ...], key: str) -> DataFrame:
    users = distinct_users(_selected(t, names))
    rows = of_users(_per_user(t.orders, scope, key), users)
    return rows.groupBy(key).agg(
        F.sum("_orders").alias("orders"), F.count(F.lit(1)).alias("buyers"),
        F.sum("_gmv").alias("_total"))


def crowd_trend(t: Tables, scope: Scope, names: tuple[str, ...] = (),
                grain: str = "day") -> DataFrame:
    key = PERIODS[grain]
    return _bought(t, scope, names, key).select(
        key, "orders", "buyers", amount(F.col("_total")).alias("gmv"))


def crowd_products(t: Tables, scope: Scope, names: tuple[str, ...] = (),
                   preview: int | None = None) -> DataFrame:
    out = _bought(t, scope, names, "sku").select(
        "sku", "orders", "buyers", rounded(F.col("_total"), 0).alias("gmv"))
    return out.orderBy(F.desc("orders"), "sku").limit(preview) if preview else out
