"""Per-user order sequence: labels, purchase rank and the order that follows.

Ordinary users need one exchange on `user_id` and one sort; every column below is a
window over that same arrangement, and columns a report does not read are pruned.
Hot users (see skew) are cut into ranges of their time line instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import qualifies, whole_days
from ..schema import LabelRule, NEW, RETURNING
from ..session import shared_folder
from .skew import split

# Total order of one user's rows. The last two only matter for rows without an id.
ORDER_KEY = ("pay_time", "sub_order_id", "sku", "influencer_name")

# Attributes of the following order that a pair carries.
NEXT_COLUMNS = (
    "pay_time", "order_ym", "order_date", "influencer_name", "sku", "gmv",
    "order_status", "category", "channel_type",
)
ADDED = ("purchase_rank", "customer_type_lifetime", "customer_type")
FIRST_COLUMNS = {
    "pay_time": "first_qualify_time",
    "influencer_name": "first_qualify_influencer",
    "sku": "first_qualify_sku",
    "gmv": "first_qualify_gmv",
}


def journey(orders: DataFrame, rule: LabelRule, hot: tuple[str, ...] = ()) -> DataFrame:
    """Add rank, labels, first qualifying order and the next order of the user.

    New columns: `purchase_rank`, `next_*` (null on the last order),
    `first_qualify_*`, `customer_type_lifetime` and `customer_type`, the rolling
    label that all reports use.
    """
    if not hot:
        return _ordinary(orders, rule)
    cold, few = split(orders, hot)
    return _ordinary(cold, rule).unionByName(_hot(few, rule))


def without_journey(orders: DataFrame) -> DataFrame:
    """Orders as they were before `journey`."""
    return orders.drop(*ADDED, *FIRST_COLUMNS.values(), *(f"next_{c}" for c in NEXT_COLUMNS))


def label(orders: DataFrame, rule: LabelRule, hot: tuple[str, ...] = ()) -> DataFrame:
    """Orders with `customer_type` under a rule; call again for other parameters."""
    kept = without_journey(orders)
    return journey(kept, rule, hot).select(*kept.columns, "customer_type")


def pairs(journeys: DataFrame) -> DataFrame:
    """One row per two consecutive orders of a user, labelled by the first.

    A projection: the first order already carries the attributes of the next one.
    """
    to = lambda c: F.col(f"next_{c}")
    return journeys.where(to("pay_time").isNotNull()).select(
        "user_id", "customer_type", "customer_type_lifetime",
        F.col("order_ym").alias("from_ym"),
        F.col("order_date").alias("from_date"),
        F.col("influencer_name").alias("from_influencer"),
        F.col("sku").alias("from_sku"),
        F.col("purchase_rank").alias("from_rank"),
        F.col("gmv").alias("from_gmv"),
        F.col("order_status").alias("from_status"),
        F.col("category").alias("from_category"),
        F.col("channel_type").alias("from_channel_type"),
        to("order_ym").alias("to_ym"),
        to("order_date").alias("to_date"),
        to("influencer_name").alias("to_influencer"),
        to("sku").alias("to_sku"),
        (F.col("purchase_rank") + 1).alias("to_rank"),
        to("gmv").alias("to_gmv"),
        to("order_status").alias("to_status"),
        to("category").alias("to_category"),
        to("channel_type").alias("to_channel_type"),
        whole_days(F.col("pay_time"), to("pay_time")).alias("days_between"),
    )


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL '{n} 00:00:00' DAY TO SECOND")


def _customer_type(returning: Column) -> Column:
    return F.when(returning, F.lit(RETURNING)).otherwise(F.lit(NEW))


def _first_struct() -> Column:
    return F.struct(*FIRST_COLUMNS)


def _unpack_first(df: DataFrame, rule: LabelRule) -> DataFrame:
    time = F.col("_first").getField("pay_time")
    return df.withColumns({
        **{name: F.col("_first").getField(c) for c, name in FIRST_COLUMNS.items()},
        "customer_type_lifetime": _customer_type(
            F.coalesce(F.col("pay_time") >= time + _days(rule.min_days), F.lit(False))),
    }).drop("_first")


def _ordinary(orders: DataFrame, rule: LabelRule) -> DataFrame:
    line = W.partitionBy("user_id").orderBy(*ORDER_KEY)
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    q = qualifies(rule)
    out = orders.withColumns({
        "purchase_rank": F.row_number().over(line).cast("long"),
        # Single columns: a struct would travel through the shuffle as a second copy.
        **{f"next_{c}": F.lead(c).over(line) for c in NEXT_COLUMNS},
        "_first": F.first(F.when(q, _first_struct()), ignorenulls=True).over(whole),
    })
    out = _unpack_first(out, rule)
    if rule.window < rule.min_days:
        return out.withColumn("customer_type", F.lit(NEW))
    # The latest qualifying time at least min_days old has the smallest age that counts.
    # This frame only grows, so each row is taken in once; the sort above serves it too.
    recent = F.expr(
        "max(_qualified) OVER (PARTITION BY user_id ORDER BY pay_time RANGE BETWEEN "
        f"UNBOUNDED PRECEDING AND INTERVAL '{rule.min_days} 00:00:00' DAY TO SECOND PRECEDING)")
    return (
        out.withColumn("_qualified", F.when(q, F.col("pay_time")))
        .withColumn("_recent", recent)
        .withColumn("customer_type", _customer_type(_within(F.col("_recent"), rule)))
        .drop("_qualified", "_recent")
    )


def _within(earlier: Column, rule: LabelRule) -> Column:
    """Whether a time is at most `window` whole days before the order."""
    return F.coalesce(F.col("pay_time") - earlier < _days(rule.window + 1), F.lit(False))


def _hot(orders: DataFrame, rule: LabelRule) -> DataFrame:
    """The same columns for users too large for one task.

    Rows are range-partitioned on (user, order key) into as many equally filled
    chunks as the session has shuffle partitions; a user is spread over as many of
    them as it needs, ties included. The chunk number is stored, as recomputing it
    may cut elsewhere. What crosses chunk borders comes
    from one summary row per (user, chunk): fewer than chunks + hot users in all,
    hence the broadcasts.
    """
    spark = orders.sparkSession
    shared_folder(spark)
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = (
        orders.repartitionByRange(chunks, "user_id", *ORDER_KEY)
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )
    inside = W.partitionBy("user_id", "_chunk").orderBy(*ORDER_KEY)
    across = W.partitionBy("user_id").orderBy("_chunk")
    key = F.struct(*ORDER_KEY)
    edges = (
        cut.groupBy("user_id", "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*NEXT_COLUMNS), key).alias("_head"))
        .select(
            "user_id", "_chunk",
            (F.sum("_n").over(across) - F.col("_n")).alias("_before"),
            F.lead("_head").over(across).alias("_following"),
        )
    )
    firsts = cut.groupBy("user_id").agg(
        F.min_by(F.when(qualifies(rule), _first_struct()),
                 F.when(qualifies(rule), key)).alias("_first"),
    )
    out = (
        cut.join(F.broadcast(edges), ["user_id", "_chunk"])
        .withColumns({
            "purchase_rank": (F.col("_before") + F.row_number().over(inside)).cast("long"),
            **{f"next_{c}": F.when(F.lead("pay_time").over(inside).isNotNull(),
                                   F.lead(c).over(inside))
               .otherwise(F.col("_following").getField(c)) for c in NEXT_COLUMNS},
        })
        .join(F.broadcast(firsts), "user_id")
    )
    out = _unpack_first(out, rule).drop("_chunk", "_before", "_following")
    return _label_by_day(out, rule)


def _label_by_day(orders: DataFrame, rule: LabelRule) -> DataFrame:
    """Rolling label from one row per (user, day): no more rows per user than days.

    Of the days that are more than `min_days` back the latest qualifying time decides; on
    the day exactly `min_days` back the time of day counts, so its earliest one does. Both
    come from frames that only grow or hold a single day.
    """
    if rule.window < rule.min_days:
        return orders.withColumn("customer_type", F.lit(NEW))
    q = F.when(qualifies(rule), F.col("pay_time"))
    days = orders.groupBy("user_id", F.col("pay_time").cast("date").alias("_day")).agg(
        F.min(q).alias("_early"), F.max(q).alias("_late"))
    line = W.partitionBy("user_id").orderBy(F.col("_daynum"))
    near = rule.min_days
    marks = days.withColumn("_daynum", F.unix_date("_day")).select(
        "user_id", "_day",
        F.max("_late").over(line.rangeBetween(W.unboundedPreceding, -near - 1)).alias("_recent"),
        F.min("_early").over(line.rangeBetween(-near, -near)).alias("_near"))
    returning = _within(F.col("_recent"), rule) | F.coalesce(
        F.col("_near") + _days(near) <= F.col("pay_time"), F.lit(False))
    return (
        orders.withColumn("_day", F.col("pay_time").cast("date"))
        .join(marks, ["user_id", "_day"])
        .withColumn("customer_type", _customer_type(returning))
        .drop("_day", "_recent", "_near")
    )
