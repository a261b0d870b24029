"""New and returning customers over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import amount, delta_percent, per, percent, rounded
from ..operators.people import summarise
from ..operators.scope import apply_scope, apply_two_scopes
from ..schema import NEW, RETURNING, Scope

PERIODS = {"day": "order_date", "month": "order_ym"}
METRICS = ("orders", "gmv", "buyers")
SUMMARY = ("orders", "buyers", "gmv", "per_buyer")


def _by_type(df: DataFrame, metric: str, *keys: str) -> DataFrame:
    """Value per group and customer type."""
    if metric == "buyers":
        # Both types always appear: a buyer is in exactly one of them.
        groups = summarise(df, *keys)
        rows = F.array(*[
            F.struct(F.lit(t).alias("customer_type"),
                     F.col(f"{t}_buyers").cast("double").alias("value"))
            for t in (NEW, RETURNING)])
        return groups.select(*keys, F.inline(rows))
    value = F.sum("gmv") if metric == "gmv" else F.count(F.lit(1))
    return df.groupBy(*keys, "customer_type").agg(amount(value).alias("value"))


def _share(df: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("value").over(W.partitionBy(*keys))
    return df.withColumn("value", rounded(percent(F.col("value"), total), 2))


def _keys(grain: str, by: str | None) -> list[str]:
    return [PERIODS[grain]] + ([by] if by else [])


def trend(orders: DataFrame, scope: Scope, grain: str = "day", metric: str = "orders",
          share: bool = False, by: str | None = None) -> DataFrame:
    """Orders, amount or persons per period and customer type, optionally in percent."""
    keys = _keys(grain, by)
    rows = _by_type(apply_scope(orders, scope), metric, *keys)
    return _share(rows, *keys) if share else rows


def _one_year_on(grain: str) -> Column:
    if grain == "day":
        return F.add_months("order_date", 12)
    year = F.substring("order_ym", 1, 4).cast("int") + 1
    return F.concat(year.cast("string"), F.substring("order_ym", 5, 3))


def trend_compare(orders: DataFrame, scope: Scope, grain: str = "day", metric: str = "orders",
                  share: bool = False) -> DataFrame:
    """One row per span and period with both types as columns.

    Periods of the comparison range are moved on by one year, to lie next to the
    current ones; two days that meet thereby are added up.
    """
    period = PERIODS[grain]
    rows = _by_type(apply_two_scopes(orders, scope), metric, "span", period)
    if share:
        rows = _share(rows, "span", period)
    moved = F.when(F.col("span") == "previous", _one_year_on(grain)).otherwise(F.col(period))
    return (
        rows.withColumn(period, moved)
        .groupBy("span", period).pivot("customer_type", [NEW, RETURNING]).agg(F.sum("value"))
        .na.fill(0.0, [NEW, RETURNING])
    )


def _summary_rows(groups: DataFrame, *keys: str) -> DataFrame:
    """From one row per group to its total / new / returning rows."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("type"),
            F.col(f"{part}orders").alias("orders"),
            F.col(f"{part}buyers").alias("buyers"),
            rounded(F.col(f"{part}gmv"), 0).alias("gmv"),
            F.when(F.col(f"{part}buyers") > 0,
                   rounded(per(F.col(f"{part}gmv"), F.col(f"{part}buyers")), 0))
            .otherwise(F.lit(0.0)).alias("per_buyer"))
        for name, part in (("total", ""), (NEW, "new_"), (RETURNING, "returning_"))])
    return groups.select(*keys, F.inline(rows))


def trend_summary(orders: DataFrame, scope: Scope) -> DataFrame:
    return _summary_rows(summarise(apply_scope(orders, scope)))


def trend_summary_compare(orders: DataFrame, scope: Scope) -> DataFrame:
    """Summary rows of both spans side by side, with absolute and relative change."""
    rows = _summary_rows(summarise(apply_two_scopes(orders, scope), "span"), "span")
    side = lambda c, span: F.coalesce(
        F.max(F.when(F.col("span") == span, F.col(c).cast("double"))), F.lit(0.0))
    wide = rows.groupBy("type").agg(*[
        side(c, span).alias(f"{c}_{span}") for c in SUMMARY for span in ("current", "previous")])
    return wide.withColumns({
        **{f"{c}_delta": F.col(f"{c}_current") - F.col(f"{c}_previous") for c in SUMMARY},
        **{f"{c}_delta_pct": delta_percent(F.col(f"{c}_current"), F.col(f"{c}_previous"))
           for c in SUMMARY},
    })


def trend_periods(orders: DataFrame, scope: Scope, grain: str = "day",
                  by: str | None = None) -> DataFrame:
    """One row per period (and group) with totals and the new / returning split."""
    keys = _keys(grain, by)
    c = F.col
    return summarise(apply_scope(orders, scope), *keys).select(
        *keys, "orders", "buyers",
        rounded(c("gmv"), 0).alias("gmv"),
        rounded(per(c("gmv"), c("buyers")), 0).alias("per_buyer"),
        "new_buyers", "returning_buyers",
        rounded(c("new_gmv"), 0).alias("new_gmv"),
        rounded(c("returning_gmv"), 0).alias("returning_gmv"))


def trend_detail(orders: DataFrame, scope: Scope, grain: str = "day",
                 by: str | None = None) -> DataFrame:
    """Long form: one row per period and customer type that has orders."""
    keys = _keys(grain, by)
    rows = F.array(*[
        F.struct(F.lit(t).alias("customer_type"), F.col(f"{t}_orders").alias("orders"),
                 rounded(F.col(f"{t}_gmv"), 2).alias("gmv"), F.col(f"{t}_buyers").alias("buyers"))
        for t in (NEW, RETURNING)])
    groups = summarise(apply_scope(orders, scope), *keys)
    return groups.select(*keys, F.inline(rows)).where(F.col("orders") > 0)
