"""Where the returning customers of a product came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, is_returning, one_of, percent, rounded
from ..operators.people import distinct_users, maybe_in, of_users
from ..operators.scope import apply_scope, scope_condition, until_month
from ..schema import Scope


@dataclass(frozen=True)
class Target:
    """Products whose returning customers are traced; empty means all."""

    categories: tuple[str, ...] = ()
    skus: tuple[str, ...] = ()

    def condition(self) -> Column:
        conds = []
        if self.categories:
            conds.append(one_of("category", self.categories))
        if self.skus:
            conds.append(one_of("sku", self.skus))
        return all_of(conds)


def _users_by(df: DataFrame, *keys: str, name: str) -> DataFrame:
    per_user = df.select(*keys, "user_id").distinct()
    return per_user.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def target_categories(orders: DataFrame, scope: Scope) -> DataFrame:
    """Categories by their returning users."""
    rows = apply_scope(orders, scope).where(is_returning())
    return _users_by(rows, "category", name="n_users").orderBy(F.desc("n_users"), "category")


def target_skus(orders: DataFrame, scope: Scope, categories: tuple[str, ...] = ()) -> DataFrame:
    """Skus of the chosen categories by their users."""
    rows = apply_scope(orders, scope).where(Target(categories).condition())
    return _users_by(rows, "sku", name="n_users").orderBy(F.desc("n_users"), "sku")


def _before(scope: Scope) -> Column:
    start = scope.dates[0]
    return (F.col("order_date") < F.lit(start)) & until_month(start)


def trace_kpi(orders: DataFrame, scope: Scope, target: Target = Target()) -> DataFrame:
    """Target returning users, their share of target buyers, and how many have a past.

    Of the past only rows that may belong to target users are combined by user.
    """
    hit = scope_condition(scope) & target.condition()
    traced = maybe_in(_returning_users(orders, scope, target))
    users = orders.where(hit | (_before(scope) & traced)).groupBy("user_id").agg(
        F.count_if(hit).alias("_hits"),
        F.count_if(hit & is_returning()).alias("_old"),
        F.count_if(_before(scope)).alias("_past"))
    out = users.agg(
        F.count_if(F.col("_hits") > 0).alias("target_buyers"),
        F.count_if(F.col("_old") > 0).alias("returning_users"),
        F.count_if((F.col("_old") > 0) & (F.col("_past") > 0)).alias("with_history"))
    return out.withColumns({
        "returning_share": rounded(percent(F.col("returning_users"), F.col("target_buyers")), 1),
        "history_share": rounded(percent(F.col("with_history"), F.col("returning_users")), 1),
    })


def _returning_users(orders: DataFrame, scope: Scope, target: Target) -> DataFrame:
    rows = apply_scope(orders, scope).where(target.condition() & is_returning())
    return distinct_users(rows)


def _history(orders: DataFrame, scope: Scope, target: Target, keys: tuple[str, ...],
             extra: Column = None) -> DataFrame:
    """Users per group in the unfiltered past, as a share of all target users.

    The scan of the past lets through what may belong to target users; that is reduced to
    distinct (group, user) before it meets those users.
    """
    users = _returning_users(orders, scope, target)
    past = orders.where(_before(scope) & maybe_in(users))
    if extra is not None:
        past = past.where(extra)
    groups = of_users(past.select(*keys, "user_id").distinct(), users)
    groups = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"))
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    return groups.withColumn("share", rounded(percent(F.col("n_users"), total), 1))


def history_by_channel(orders: DataFrame, scope: Scope, target: Target = Target()) -> DataFrame:
    return _history(orders, scope, target, ("channel_type",))


def history_by_influencer(orders: DataFrame, scope: Scope, target: Target = Target(),
                          top: int | None = None) -> DataFrame:
    """Per channel type and influencer; `top` for the leading rows only."""
    out = _history(orders, scope, target, ("channel_type", "influencer_name"))
    if top:
        out = out.orderBy(F.desc("n_users"), "channel_type", "influencer_name").limit(top)
    return out


def _source(channels: tuple[str, ...], influencers: tuple[str, ...]) -> Column:
    conds = []
    if channels:
        conds.append(one_of("channel_type", channels))
    if influencers:
        conds.append(one_of("influencer_name", influencers))
    return all_of(conds)


def history_of_source(orders: DataFrame, scope: Scope, target: Target = Target(),
                      channels: tuple[str, ...] = (), influencers: tuple[str, ...] = ()) -> DataFrame:
    """Target users with a past at the chosen sources, and their share of all target users."""
    users = _returning_users(orders, scope, target)
    past = distinct_users(orders.where(_before(scope) & _source(channels, influencers) & maybe_in(users)))
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = of_users(past, users).agg(F.count(F.lit(1)).alias("n_users"))
    return found.select("n_users", total.alias("target_users"),
                        rounded(percent(F.col("n_users"), total), 1).alias("share"))


def influencers_on_offer(orders: DataFrame, scope: Scope, target: Target = Target(),
                         channels: tuple[str, ...] = ()) -> DataFrame:
    """Influencers of the chosen channels in the past of target users, by their users."""
    out = history_by_influencer(orders, scope, target).where(_source(channels, ()))
    return out.select("channel_type", "influencer_name", "n_users").orderBy(
        F.desc("n_users"), "channel_type", "influencer_name")


def history_by_category(orders: DataFrame, scope: Scope, target: Target = Target(),
                        channels: tuple[str, ...] = (), influencers: tuple[str, ...] = (),
                        top: int | None = None) -> DataFrame:
    """Per category, optionally only from certain sources; target categories flagged."""
    out = _history(orders, scope, target, ("category",), _source(channels, influencers))
    chosen = one_of("category", target.categories) if target.categories else F.lit(False)
    out = out.withColumn("is_target", chosen)
    return out.orderBy(F.desc("n_users"), "category").limit(top) if top else out
