"""Summary per channel type or influencer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import delta_percent, percent
from ..operators.people import as_double, summarise, summary_columns
from ..operators.scope import apply_scope, apply_two_scopes
from ..schema import Scope

MONEY = ("gmv", "new_gmv", "returning_gmv")
SHOWN = ("orders", "buyers", "gmv", "per_buyer", "frequency", "new_buyers",
         "returning_buyers", "new_share", "returning_share", "new_per_buyer",
         "returning_per_buyer", "new_orders", "returning_orders", "new_gmv", "returning_gmv")
COMPARED = ("orders", "buyers", "gmv", "per_buyer")


def grouping(scope: Scope, by: str | None = None) -> str:
    """Influencers once some are selected, else channel types."""
    return by or ("influencer_name" if scope.influencers else "channel_type")


def channel_summary(orders: DataFrame, scope: Scope, by: str | None = None) -> DataFrame:
    by = grouping(scope, by)
    groups = summarise(apply_scope(orders, scope), by)
    return as_double(groups.withColumns(summary_columns()), *MONEY).select(by, *SHOWN)


def channel_shares(orders: DataFrame, scope: Scope, by: str | None = None) -> DataFrame:
    """Share of each group in the sum over all groups, in percent."""
    by = grouping(scope, by)
    parts = ("orders", "gmv", "buyers")
    groups = summarise(apply_scope(orders, scope), by).select(by, *parts)
    # Same aggregate as the rows themselves, so its exchange is reused.
    totals = groups.agg(F.struct(*[F.sum(c).alias(c) for c in parts])).scalar()
    out = groups.withColumns({
        f"{c}_share": percent(F.col(c), totals.getField(c)) for c in parts})
    return as_double(out, "gmv")


def channel_listing(orders: DataFrame, scope: Scope, by: str | None = None) -> DataFrame:
    """Current and comparison rows below each other, told apart by `span`."""
    by = grouping(scope, by)
    groups = summarise(apply_two_scopes(orders, scope), "span", by)
    return as_double(groups.withColumns(summary_columns()), *MONEY).select("span", by, *SHOWN)


def channel_change(orders: DataFrame, scope: Scope, by: str | None = None) -> DataFrame:
    """Change per group; a group missing on one side counts as zero there."""
    by = grouping(scope, by)
    rows = channel_listing(orders, scope, by)
    side = lambda c, span: F.coalesce(
        F.max(F.when(F.col("span") == span, F.col(c).cast("double"))), F.lit(0.0))
    wide = rows.groupBy(by).agg(*[
        side(c, span).alias(f"{c}_{span}") for c in COMPARED for span in ("current", "previous")])
    return wide.withColumns({
        f"{c}_change_pct": delta_percent(F.col(f"{c}_current"), F.col(f"{c}_previous"))
        for c in COMPARED})
