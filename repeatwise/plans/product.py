"""Products: ranking, new / returning split, full table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, is_new, percent, rounded
from ..operators.people import measures, merge_users, per_user, summarise
from ..operators.scope import apply_scope
from ..schema import Scope

def search(orders: DataFrame, keyword: str) -> DataFrame:
    """Skus matching a case-insensitive regular expression."""
    return orders.where(F.col("sku").rlike(f"(?i){keyword}")) if keyword else orders


def _with_store_total(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """The used measures per sku, and those of all skus together.

    Buyers of several skus count once in the store. Both come from the same rows per
    sku and user, and as both read the same measures they share that exchange.
    """
    users = per_user(df, "sku")
    store = measures(merge_users(users)).select(F.struct(*used)).scalar()
    return measures(users, "sku"), store


def _amounts(df: DataFrame) -> DataFrame:
    """Amounts per sku; no shuffle by person."""
    out = df.groupBy("sku").agg(
        F.sum("gmv").alias("gmv"),
        F.coalesce(F.sum(F.when(is_new(), F.col("gmv"))), F.lit(0)).alias("new_gmv"))
    return out.withColumn("returning_gmv", F.col("gmv") - F.col("new_gmv"))


def product_rank(orders: DataFrame, scope: Scope, metric: str = "gmv", keyword: str = "",
                 top: int = 50) -> DataFrame:
    """Leading skus by amount or buyers, with their share of the store."""
    rows = search(apply_scope(orders, scope), keyword)
    if metric == "gmv":  # amounts add up without regard to persons
        groups = _amounts(rows)
        store = groups.agg(F.struct(F.sum("gmv").alias("gmv"), F.sum("new_gmv"))).scalar()
    else:
        groups, store = _with_store_total(rows, (metric,))
    best = groups.select("sku", amount(F.col(metric)).alias("total"))
    best = best.orderBy(F.desc("total"), "sku").limit(top)
    return best.withColumn("store_share", rounded(percent(F.col("total"), store.getField(metric)), 2))


def product_split(orders: DataFrame, scope: Scope, metric: str = "gmv",
                  keyword: str = "") -> DataFrame:
    """New and returning part of each sku; buyers are new or returning, not both."""
    rows = search(apply_scope(orders, scope), keyword)
    groups = (_amounts(rows) if metric == "gmv" else summarise(rows, "sku")).select(
        "sku", amount(F.col(f"new_{metric}")).alias("new"),
        amount(F.col(f"returning_{metric}")).alias("returning"),
        amount(F.col(metric)).alias("total"))
    return groups.withColumns({
        "new_pct": percent(F.col("new"), F.col("total")),
        "returning_pct": percent(F.col("returning"), F.col("total")),
    })


def product_table(orders: DataFrame, scope: Scope, keyword: str = "") -> DataFrame:
    """Amount and persons per sku.

    Here a buyer with both kinds of orders counts among the new and among the
    returning ones, unlike everywhere else.
    """
    groups, store = _with_store_total(
        search(apply_scope(orders, scope), keyword),
        ("gmv", "new_gmv", "buyers", "new_buyers", "any_returning_buyers"))
    c = F.col
    whole = lambda x: rounded(x, 0).cast("long")
    share = lambda n, d: rounded(percent(n, d), 2)
    return groups.select(
        "sku",
        whole(c("gmv")).alias("gmv"),
        share(c("gmv"), store.getField("gmv")).alias("gmv_store_share"),
        whole(c("new_gmv")).alias("new_gmv"),
        whole(c("returning_gmv")).alias("returning_gmv"),
        share(c("new_gmv"), c("gmv")).alias("new_gmv_share"),
        share(c("returning_gmv"), c("gmv")).alias("returning_gmv_share"),
        "buyers",
        share(c("buyers"), store.getField("buyers")).alias("buyers_store_share"),
        "new_buyers",
        c("any_returning_buyers").alias("returning_buyers"),
        share(c("new_buyers"), c("buyers")).alias("new_buyers_share"),
        share(c("any_returning_buyers"), c("buyers")).alias("returning_buyers_share"))
