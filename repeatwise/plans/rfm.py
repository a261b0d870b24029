"""Recency, frequency and amount of past buyers, and who of them bought again."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    amount, first_match, midnight, money, one_of, percent, rounded, whole_days,
)
from ..operators.scope import scope_condition, until_month
from ..schema import LabelRule, Scope

# Buckets as (label, low, high); high None is open.
# Recency in days, low exclusive and high inclusive.
R_BUCKETS = (
    ("0-30", 0, 30),
    ("30-60", 30, 60),
    ("60-90", 60, 90),
    ("90-180", 90, 180),
    ("180-365", 180, 365),
    ("365+", 365, None),
)
# Number of orders.
F_BUCKETS = (
    ("1", 1, 1),
    ("2", 2, 2),
    ("3-5", 3, 5),
    ("6-10", 6, 10),
    ("10+", 11, None),
)
# Total amount, both ends inclusive; an edge belongs to the lower bucket.
M_BUCKETS = (
    ("0-500", 0, 500),
    ("500-2000", 500, 2000),
    ("2000-5000", 2000, 5000),
    ("5000-10000", 5000, 10000),
    ("10000+", 10000, None),
)
# Days between recency buckets unless others are given.
DEFAULT_BREAKPOINTS = (0, 15, 45, 90, 180, 365)
# A whole number of days; entries stand between commas of either width.
_DAYS = re.compile(r"\s*([+-]?\d+)\s*")


def parse_breakpoints(text: str) -> list[int]:
    """Days typed by a user; an entry that isn't a whole number is named in the error."""
    days = []
    for entry in re.split("[,，]", text):
        found = _DAYS.fullmatch(entry)
        if found:
            days.append(int(found[1]))
        elif entry and not entry.isspace():
            raise ValueError(f"'{entry.strip()}' is not a whole number of days")
    return days


def recency_buckets(breakpoints: Sequence[int] = DEFAULT_BREAKPOINTS) -> tuple:
    """Buckets between sorted distinct non-negative breakpoints, from zero, open at the end."""
    edges = sorted({0, *(b for b in breakpoints if b >= 0)})
    closed = [(f"{a}-{b}", a, b) for a, b in zip(edges, edges[1:])]
    return (*closed, (f"{edges[-1]}+", edges[-1], None))


def amount_buckets(edges: list[int]) -> tuple:
    closed = [(f"{a}-{b}", a, b) for a, b in zip(edges, edges[1:])]
    return (*closed, (f"{edges[-1]}+", edges[-1], None))


def cutoff(scope: Scope) -> dt.date:
    """Recency is counted back from the day before the range starts."""
    return scope.dates[0] - dt.timedelta(days=1)


def date_label(low: int, high: int | None, day: dt.date) -> str:
    """Calendar days a recency bucket stands for."""
    back = lambda n: (day - dt.timedelta(days=n)).isoformat()
    return f"<= {back(low)}" if high is None else f"{back(high - 1)} ~ {back(low)}"


def rfm_users(orders: DataFrame, scope: Scope, rule: LabelRule,
              base_channels: tuple[str, ...] = (), r_buckets=R_BUCKETS, f_buckets=F_BUCKETS,
              m_buckets=M_BUCKETS, inclusive_days: bool = False) -> DataFrame:
    """One row per user with a qualifying order up to the cutoff.

    Past and later orders of a user come out of a single aggregate. The base ignores
    the scope's dates, channels, influencers and statuses; what counts as bought
    again follows the scope. Cutoff and end are taken as midnight, so orders later
    on these days are outside both, unless `inclusive_days`.
    """
    start, last = scope.dates
    if inclusive_days:
        tick = F.expr("INTERVAL '0 00:00:00.000001' DAY TO SECOND")
        cut = midnight(start) - tick
        end = midnight(last + dt.timedelta(days=1)) - tick
    else:
        cut, end = midnight(cutoff(scope)), midnight(last)
    base = (
        scope_condition(scope, dates=False, channels=False, influencers=False, statuses=False)
        & one_of("order_status", rule.statuses) & (F.col("gmv") >= money(rule.min_amount))
        & (F.col("pay_time") <= cut) & until_month(cutoff(scope))
    )
    if base_channels:
        base = base & one_of("channel_type", base_channels)
    later = scope_condition(scope) & (F.col("pay_time") > cut) & (F.col("pay_time") <= end)
    users = (
        orders.where(base | later).groupBy("user_id").agg(
            F.max(F.when(base, F.col("pay_time"))).alias("last_pay"),
            F.count_if(base).alias("order_count"),
            F.sum(F.when(base, F.col("gmv"))).alias("_gmv"),
            F.count_if(later).alias("_later"),
            F.coalesce(F.sum(F.when(later, F.col("gmv"))), F.lit(0)).alias("_later_gmv"))
        .where(F.col("order_count") > 0)
    )
    r_days = whole_days(F.col("last_pay"), cut)
    return users.select(
        "user_id", "last_pay", "order_count",
        amount(F.col("_gmv")).alias("total_gmv"),
        r_days.alias("r_days"),
        F.when(F.col("_later") > 0, 1).otherwise(0).cast("long").alias("is_repurchase"),
        amount(F.col("_later_gmv")).alias("repurchase_gmv"),
        # The decimal itself, as its sums do not depend on their order.
        F.col("_later_gmv").alias("_exact_gmv"),
        first_match(r_days, r_buckets, "right").alias("r_bucket"),
        first_match(F.col("order_count"), f_buckets, "both").alias("f_bucket"),
        first_match(F.col("_gmv"), m_buckets, "both").alias("m_bucket"))


def rfm_table(users: DataFrame, dim: str, buckets, day: dt.date | None = None) -> DataFrame:
    """Base, repurchasers, amount and rate per bucket, empty ones included, and TTL.

    `dim` is r, f or m. With `day` each bucket gets the calendar days it stands for.
    The total adds up the rows shown, with their rounded amounts.
    """
    spark = users.sparkSession
    frame = spark.createDataFrame(
        [(i, label, date_label(low, high, day) if day else None)
         for i, (label, low, high) in enumerate(buckets)],
        "pos long, bucket string, date_range string")
    found = users.groupBy(F.col(f"{dim}_bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("base"),
        F.sum("is_repurchase").alias("repurchasers"),
        F.sum("_exact_gmv").alias("amount"))
    zero = F.lit(0)
    # At most one row per bucket comes out of the aggregate.
    rows = frame.join(F.broadcast(found), "bucket", "left").select(
        "pos", "bucket", "date_range",
        F.coalesce("base", zero).alias("base"),
        F.coalesce("repurchasers", zero).alias("repurchasers"),
        rounded(F.coalesce("amount", zero), 0).alias("amount"))
    keys = ["pos", "bucket", "date_range"]
    sums = [F.sum(c).alias(c) for c in ("base", "repurchasers", "amount")]
    out = rows.groupingSets([keys, []], *keys).agg(F.grouping("pos").alias("_all"), *sums)
    total = F.col("_all") == 1
    return out.select(
        F.when(total, F.lit(len(buckets)).cast("long")).otherwise(F.col("pos")).alias("pos"),
        F.when(total, F.lit("TTL")).otherwise(F.col("bucket")).alias("bucket"),
        *([F.when(total, F.lit("-")).otherwise(F.col("date_range")).alias("date_range")]
          if day else []),
        "base", "repurchasers", "amount",
        rounded(percent(F.col("repurchasers"), F.col("base")), 2).alias("rate"))


def rfm_cross(users: DataFrame, r_buckets=R_BUCKETS, f_buckets=F_BUCKETS) -> DataFrame:
    """Every recency x frequency cell; the rate of an empty cell is null."""
    spark = users.sparkSession
    cells = spark.createDataFrame(
        [(r[0], f[0]) for r in r_buckets for f in f_buckets], "r_bucket string, f_bucket string")
    found = users.groupBy("r_bucket", "f_bucket").agg(
        F.count(F.lit(1)).alias("base"), F.sum("is_repurchase").alias("repurchasers"))
    return cells.join(F.broadcast(found), ["r_bucket", "f_bucket"], "left").select(
        "r_bucket", "f_bucket",
        F.coalesce("base", F.lit(0)).alias("base"),
        F.coalesce("repurchasers", F.lit(0)).alias("repurchasers"),
        rounded(F.try_divide(F.col("repurchasers").cast("double"), F.col("base").cast("double"))
                * 100.0, 2).alias("rate"))


def rfm_cross_matrix(users: DataFrame, r_buckets=R_BUCKETS, f_buckets=F_BUCKETS) -> DataFrame:
    """Rates with frequency buckets as columns f_1, f_2, ..."""
    cells = rfm_cross(users, r_buckets, f_buckets)
    wide = cells.groupBy("r_bucket").pivot("f_bucket", [b[0] for b in f_buckets]).agg(F.first("rate"))
    return wide.toDF("r_bucket", *[f"f_{b[0].replace('-', '_').replace('+', '_up')}" for b in f_buckets])


def rfm_export(users: DataFrame, preview: int | None = None) -> DataFrame:
    """User-level rows for export; a preview shows the first ones by user."""
    out = users.drop("_exact_gmv").withColumn("total_gmv", rounded(F.col("total_gmv"), 2))
    return out.orderBy("user_id").limit(preview) if preview else out
