"""Trial samples and what their buyers went on to buy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, amount, midnight, one_of, per, percent, qualifies, rounded
from ..operators.people import distinct_users, maybe_in, of_users
from ..operators.scope import apply_scope, in_days, scope_condition, until_month
from ..operators.skew import split
from ..schema import DateRange, LabelRule, Scope, Tables

PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


@dataclass(frozen=True)
class SampleScope:
    """Filter on samples; empty means all."""

    dates: DateRange | None = None
    statuses: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    skus: tuple[str, ...] = ()


def sample_filter(samples: DataFrame, s: SampleScope) -> DataFrame:
    conds = []
    if s.dates:
        conds.append(in_days("order", s.dates))
    for column, values in (("order_status", s.statuses), ("sample_type", s.types), ("sku", s.skus)):
        if values:
            conds.append(one_of(column, values))
    return samples.where(all_of(conds))


def sample_choices(samples: DataFrame, s: SampleScope) -> DataFrame:
    """Types and skus on offer: those that occur in the chosen days."""
    window = sample_filter(samples, SampleScope(dates=s.dates))
    return window.select("sample_type", "sku").distinct()


def first_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("user_id").agg(
        F.min("pay_time").alias("sample_time"), F.count(F.lit(1)).alias("sample_orders"))


def _users(orders: DataFrame, scope: Scope, rule: LabelRule, sampled: DataFrame) -> DataFrame:
    """Per user: orders in scope and a year earlier, and whether known before.

    Only of users that have a row in `sampled`, and of few others.
    """
    now = scope_condition(scope)
    year_ago = scope.year_ago()
    then = scope_condition(year_ago) if year_ago else F.lit(False)
    # Known customer: a qualifying order, of any channel, before the range starts.
    known = F.lit(False)
    if scope.dates:
        any_channel = LabelRule(rule.min_amount, statuses=rule.statuses)
        start = scope.dates[0]
        known = qualifies(any_channel) & (F.col("pay_time") < midnight(start)) & until_month(start)
    return orders.where((now | then | known) & maybe_in(sampled)).groupBy("user_id").agg(
        F.count_if(now).alias("_orders"), F.sum(F.when(now, F.col("gmv"))).alias("_gmv"),
        F.count_if(then).alias("_orders_prev"), F.sum(F.when(then, F.col("gmv"))).alias("_gmv_prev"),
        F.count_if(known).alias("_known"))


def _after_sample(t: Tables, buyers: DataFrame, scope: Scope) -> DataFrame:
    """Orders in scope per user, counting only those after the first sample.

    The comparison needs single orders, so hot users' orders stay in place and meet
    their few sample rows by broadcast.
    """
    orders = apply_scope(t.orders, scope).where(maybe_in(buyers))
    if t.hot_users:
        (cold, hot), (cold_buyers, hot_buyers) = split(orders, t.hot_users), split(buyers, t.hot_users)
        rows = cold.join(cold_buyers, "user_id").unionByName(
            hot.join(F.broadcast(hot_buyers), "user_id"))
    else:
        rows = orders.join(buyers, "user_id")
    return rows.where(F.col("pay_time") > F.col("sample_time")).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.sum("gmv").alias("_gmv"))


def sample_buyers(t: Tables, scope: Scope, rule: LabelRule, s: SampleScope = SampleScope(),
                  after_sample: bool = False) -> DataFrame:
    """One row per sample buyer with what they bought, whether or not after the sample.

    `after_sample` counts only orders after the first sample.
    """
    sampled = sample_filter(t.need("samples"), s)
    buyers = first_samples(sampled)
    users = _users(t.orders, scope, rule, sampled)
    if after_sample:
        users = users.drop("_orders", "_gmv").join(
            _after_sample(t, buyers.select("user_id", "sample_time"), scope),
            "user_id", "left")
    zero = F.lit(0)
    return buyers.join(users, "user_id", "left").select(
        "user_id", "sample_time", "sample_orders",
        *[F.coalesce(c, zero).alias(c) for c in ("_orders", "_gmv", "_orders_prev", "_gmv_prev")],
        (F.coalesce("_known", zero) == 0).alias("is_new"))


def sample_kpi(t: Tables, scope: Scope, rule: LabelRule, s: SampleScope = SampleScope(),
               after_sample: bool = False) -> DataFrame:
    """One row of headline figures; `*_prev` are the same buyers a year earlier."""
    zero = F.lit(0)
    figures = [
        F.coalesce(F.sum("sample_orders"), zero).alias("sample_orders"),
        F.count(F.lit(1)).alias("buyers"),
        F.count_if("is_new").alias("new_buyers"),
    ]
    for end in ("", "_prev"):
        repeat = F.col(f"_orders{end}") > 0
        figures += [
            F.count_if(repeat).alias(f"repeat_users{end}"),
            F.count_if(repeat & F.col("is_new")).alias(f"repeat_new{end}"),
            F.coalesce(F.sum(f"_orders{end}"), zero).alias(f"repeat_orders{end}"),
            amount(F.coalesce(F.sum(f"_gmv{end}"), zero)).alias(f"repeat_gmv{end}"),
        ]
    out = sample_buyers(t, scope, rule, s, after_sample).agg(*figures)
    for end in ("", "_prev"):
        out = out.withColumns({
            f"acquisition_rate{end}": per(F.col(f"repeat_new{end}"), F.col("buyers")),
            f"repeat_rate{end}": per(F.col(f"repeat_users{end}"), F.col("buyers")),
        })
    return out


def sample_kpi_compare(t: Tables, scope: Scope, rule: LabelRule,
                       s: SampleScope = SampleScope()) -> DataFrame:
    """Difference of each figure between the current range and a year earlier."""
    names = ("acquisition_rate", "repeat_users", "repeat_new", "repeat_orders", "repeat_rate",
             "repeat_gmv")
    row = sample_kpi(t, scope, rule, s)
    figures = F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("current_value"),
                 F.col(f"{n}_prev").cast("double").alias("previous_value")) for n in names])
    return row.select(F.inline(figures)).withColumn(
        "delta", F.col("current_value") - F.col("previous_value"))


def sample_cohort(t: Tables, scope: Scope, rule: LabelRule, s: SampleScope = SampleScope(),
                  grain: str = "month") -> DataFrame:
    """By the period of the first sample."""
    buyers = sample_buyers(t, scope, rule, s)
    out = buyers.groupBy(F.date_format("sample_time", PERIODS[grain]).alias("period")).agg(
        F.count(F.lit(1)).alias("buyers"),
        F.count_if(F.col("_orders") > 0).alias("repeat_users"),
        F.sum("_orders").alias("repeat_orders"))
    return out.withColumn(
        "rate", rounded(percent(F.col("repeat_users"), F.col("buyers")), 2))


def sample_products(t: Tables, scope: Scope, s: SampleScope = SampleScope(),
                    preview: int | None = None) -> DataFrame:
    """What sample buyers bought in scope, per sku."""
    buyers = distinct_users(sample_filter(t.need("samples"), s))
    per_user = apply_scope(t.orders, scope).where(maybe_in(buyers)).groupBy("sku", "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("gmv").alias("_gmv"))
    out = of_users(per_user, buyers).groupBy("sku").agg(
        F.sum("_n").alias("repeat_orders"), F.count(F.lit(1)).alias("repeat_users"),
        rounded(F.sum("_gmv"), 0).alias("repeat_gmv"))
    if preview:
        out = out.orderBy(F.desc("repeat_orders"), "sku").limit(preview)
    return out


def sample_detail(t: Tables, scope: Scope, rule: LabelRule,
                  s: SampleScope = SampleScope()) -> DataFrame:
    """Per sample type and sku, with a subtotal per type that counts users once.

    `sku` is null on subtotals.
    """
    grains = ["sample_type", "sku", "user_id"]
    sampled = sample_filter(t.need("samples"), s)
    membership = (
        sampled.groupingSets([grains, ["sample_type", "user_id"]], *grains)
        .agg(F.grouping("sku").alias("_subtotal"), F.count(F.lit(1)).alias("_samples"))
    )
    zero = F.lit(0)
    rows = membership.join(_users(t.orders, scope, rule, sampled), "user_id", "left")
    new = F.coalesce("_known", zero) == 0
    repeat = F.coalesce("_orders", zero) > 0
    out = rows.groupBy("sample_type", "sku", "_subtotal").agg(
        F.sum("_samples").alias("sample_orders"),
        F.count(F.lit(1)).alias("buyers"),
        F.count_if(new).alias("new_buyers"),
        F.count_if(repeat).alias("repeat_users"),
        F.count_if(repeat & new).alias("repeat_new"),
        F.sum(F.coalesce("_orders", zero)).alias("repeat_orders"),
        rounded(F.sum(F.coalesce("_gmv", zero)), 0).alias("repeat_gmv"))
    return out.select(
        F.when(F.col("_subtotal") == 1, "subtotal").otherwise("sku").alias("level"),
        "sample_type", "sku", "sample_orders", "buyers", "new_buyers", "repeat_users",
        "repeat_new", "repeat_orders", "repeat_gmv",
        rounded(per(F.col("repeat_gmv"), F.col("repeat_users")), 0).alias("gmv_per_repeat_user"),
        rounded(percent(F.col("repeat_users"), F.col("buyers")), 2).alias("rate"))
