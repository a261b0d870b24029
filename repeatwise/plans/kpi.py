"""Headline figures and their change against the comparison range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, delta_percent, per, percent, rounded
from ..operators.people import summarise
from ..operators.scope import apply_scope, apply_two_scopes
from ..schema import Scope

PARTS = ("", "new_", "returning_")
HEADLINES = tuple(
    f"{part}{m}" for m in ("orders", "gmv", "buyers", "frequency", "per_buyer") for part in PARTS
) + ("new_share", "returning_share")


def _or_zero(value: Column, buyers: Column) -> Column:
    return F.when(buyers > 0, value).otherwise(F.lit(0.0))


def headline_columns() -> dict[str, Column]:
    """Figures per buyer; zero where a group has no buyers."""
    out: dict[str, Column] = {}
    for part in PARTS:
        orders, gmv, buyers = (F.col(f"{part}{m}") for m in ("orders", "gmv", "buyers"))
        out[f"{part}frequency"] = _or_zero(rounded(per(orders, buyers), 2), buyers)
        out[f"{part}per_buyer"] = _or_zero(rounded(per(gmv, buyers), 0), buyers)
    for part in PARTS[1:]:
        share = rounded(percent(F.col(f"{part}buyers"), F.col("buyers")), 1)
        out[f"{part}share"] = _or_zero(share, F.col("buyers"))
    return out


def kpi(orders: DataFrame, scope: Scope) -> DataFrame:
    """One row: orders, amount, buyers and ratios for all, new and returning."""
    out = summarise(apply_scope(orders, scope)).withColumns(headline_columns())
    return out.select(*[
        amount(F.col(c)).alias(c) if c.endswith("gmv") else F.col(c) for c in HEADLINES])


def kpi_compare(orders: DataFrame, scope: Scope) -> DataFrame:
    """One row per figure: current, previous, change and change in percent."""
    spans = summarise(apply_two_scopes(orders, scope), "span").withColumns(headline_columns())
    pick = lambda c, span: F.coalesce(
        F.max(F.when(F.col("span") == span, F.col(c).cast("double"))), F.lit(0.0))
    row = spans.agg(*[pick(c, span).alias(f"{c}_{span}")
                      for c in HEADLINES for span in ("current", "previous")])
    figures = F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(f"{c}_current").alias("current_value"),
                 F.col(f"{c}_previous").alias("previous_value")) for c in HEADLINES])
    return row.select(F.inline(figures)).withColumns({
        "delta": F.col("current_value") - F.col("previous_value"),
        "delta_pct": delta_percent(F.col("current_value"), F.col("previous_value")),
    })
