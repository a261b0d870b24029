"""Report filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, money, one_of
from ..schema import DateRange, Scope


# Tables are stored by month; the month conditions below follow from the days and let
# the scan skip the other months.

def in_days(side: str, dates: DateRange) -> Column:
    """Days of a range, both ends included, by `<side>_date` and `<side>_ym`."""
    first, last = dates
    return F.col(f"{side}_date").between(F.lit(first), F.lit(last)) & F.col(f"{side}_ym").between(
        f"{first:%Y-%m}", f"{last:%Y-%m}")


def until_month(day: dt.date) -> Column:
    """Months up to that of a day."""
    return F.col("order_ym") <= f"{day:%Y-%m}"


def scope_condition(s: Scope, dates: bool = True, channels: bool = True,
                    influencers: bool = True, statuses: bool = True) -> Column:
    """Predicate of a scope on orders; parts can be left out for single reports."""
    conds = []
    if dates and s.dates:
        conds.append(in_days("order", s.dates))
    if s.categories:
        conds.append(one_of("category", s.categories))
    if channels and s.channels:
        conds.append(one_of("channel_type", s.channels))
    if influencers and s.influencers:
        conds.append(one_of("influencer_name", s.influencers))
    conds += _sku_conditions("sku", s)
    if statuses and s.statuses:
        conds.append(one_of("order_status", s.statuses))
    if s.after_sale:
        conds.append(one_of("after_sale_status", s.after_sale))
    conds.append(F.col("gmv") >= money(s.min_amount))
    if s.max_amount is not None:
        conds.append(F.col("gmv") <= money(s.max_amount))
    return all_of(conds)


def _sku_conditions(column: str, s: Scope) -> list[Column]:
    if s.skus:
        return [one_of(column, s.skus)]
    if s.sku_keyword:
        return [F.contains(F.lower(F.col(column)), F.lower(F.lit(s.sku_keyword)))]
    return []


def apply_scope(orders: DataFrame, s: Scope) -> DataFrame:
    return orders.where(scope_condition(s))


def apply_two_scopes(orders: DataFrame, s: Scope) -> DataFrame:
    """Rows of the current and of the comparison range in one pass.

    Adds `span` (current / previous); a row inside both ranges appears twice.
    """
    current, year_ago = scope_condition(s), s.year_ago()
    previous = scope_condition(year_ago) if year_ago else F.lit(False)
    both, one, other = (F.array(*map(F.lit, names)) for names in (
        ("current", "previous"), ("current",), ("previous",)))
    spans = F.when(current & previous, both).when(current, one).otherwise(other)
    return orders.where(current | previous).withColumn("span", F.explode(spans))


def scope_pairs(pairs: DataFrame, s: Scope, align: bool = False) -> DataFrame:
    """Pairs whose first order is in scope.

    By default category, status, after-sale and maximum amount do not apply here;
    `align` applies those a pair carries, so that pairs follow the order filter. A keyword
    means skus that occur in the chosen categories, as in the choices offered for orders.
    """
    conds = []
    if s.dates:
        conds.append(in_days("from", s.dates))
    if s.channels:
        conds.append(one_of("from_channel_type", s.channels))
    if s.influencers:
        conds.append(one_of("from_influencer", s.influencers))
    conds += _sku_conditions("from_sku", s)
    if s.min_amount > 0:
        conds.append(F.col("from_gmv") >= money(s.min_amount))
    if align:
        if s.categories:
            conds.append(one_of("from_category", s.categories))
        if s.statuses:
            conds.append(one_of("from_status", s.statuses))
        if s.max_amount is not None:
            conds.append(F.col("from_gmv") <= money(s.max_amount))
    found = pairs.where(all_of(conds))
    if not s.sku_keyword or s.skus or not s.categories:
        return found
    of_category = pairs.where(one_of("from_category", s.categories))
    linked = of_category.where(all_of(_sku_conditions("from_sku", s))) \
        .select(F.col("from_sku").alias("_linked")).distinct()
    # Categories that match nothing restrict nothing.
    return found.join(linked, F.col("from_sku") == F.col("_linked"), "left") \
        .where(F.col("_linked").isNotNull() | ~of_category.exists()).drop("_linked")


def choices(orders: DataFrame, of: str, linked_to: str, selected: tuple[str, ...]) -> DataFrame:
    """Values of one dimension that occur together with selected values of another.

    No selection, or one that matches nothing, offers every value.
    """
    values = orders.select(of, linked_to).distinct()
    if not selected:
        return values.select(of).distinct()
    hit = one_of(linked_to, selected)
    some = orders.where(hit).exists()
    return values.where(hit | ~some).select(of).distinct()


def linked_choices(catalogue: DataFrame, of: str, linked_to: str, selected: tuple[str, ...]) -> DataFrame:
    """The same as `choices`, read off the stored catalogue instead of the orders."""
    every = catalogue.where((F.col("kind") == of) & F.col("parent").isNull()).select(F.col("value").alias(of))
    if not selected:
        return every.distinct()
    linked = catalogue.where((F.col("kind") == f"{linked_to}/{of}") & one_of("parent", selected)) \
        .select(F.col("value").alias(of))
    # Selected values that nothing is linked to offer every value.
    return linked.unionByName(every.where(~linked.exists())).distinct()
