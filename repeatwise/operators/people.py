"""Two-level aggregation: per user first, then per group.

The inner level combines a user's rows before they are shuffled, so a user or group
holding much of the data costs no more than any other. Counting users afterwards is
a plain count; no distinct aggregate is needed. A user with at least one new order
in a group counts there as new, otherwise as returning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, is_new, per, percent, rounded

MEASURES = (
    "orders", "gmv", "buyers", "new_orders", "new_gmv", "new_buyers",
    "returning_orders", "returning_gmv", "returning_buyers",
)


def per_user(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("_orders"),
        F.sum("gmv").alias("_gmv"),
        F.count_if(is_new()).alias("_new_orders"),
        F.sum(F.when(is_new(), F.col("gmv"))).alias("_new_gmv"),
    )


def merge_users(users: DataFrame, *keys: str) -> DataFrame:
    """Coarser `per_user` rows from finer ones."""
    return users.groupBy(*keys, "user_id").agg(*[
        F.sum(c).alias(c) for c in ("_orders", "_gmv", "_new_orders", "_new_gmv")])


def measures(users: DataFrame, *keys: str) -> DataFrame:
    """Measures per group from `per_user` rows; without keys one row for all."""
    zero = F.lit(0)
    out = users.groupBy(*keys).agg(
        F.coalesce(F.sum("_orders"), zero).alias("orders"),
        F.coalesce(F.sum("_gmv"), zero).alias("gmv"),
        F.count(F.lit(1)).alias("buyers"),
        F.coalesce(F.sum("_new_orders"), zero).alias("new_orders"),
        F.coalesce(F.sum("_new_gmv"), zero).alias("new_gmv"),
        F.count_if(F.col("_new_orders") > 0).alias("new_buyers"),
        F.count_if(F.col("_orders") > F.col("_new_orders")).alias("any_returning_buyers"),
    )
    return out.withColumns({
        "returning_orders": F.col("orders") - F.col("new_orders"),
        "returning_gmv": F.col("gmv") - F.col("new_gmv"),
        "returning_buyers": F.col("buyers") - F.col("new_buyers"),
    })


def summarise(df: DataFrame, *keys: str) -> DataFrame:
    return measures(per_user(df, *keys), *keys)


def distinct_users(df: DataFrame) -> DataFrame:
    """One row per user.

    The null test is what a join on the user would add by itself; stated here, the
    set and a count of it have the same plan and share one exchange.
    """
    return df.where(F.col("user_id").isNotNull()).select("user_id").distinct()


def of_users(combined: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of `combined`, an aggregate per user and key, whose user is in `users`.

    `users` has one row per user. A semi join would be moved below the aggregate and
    bring all rows of a large user to one task; an inner join stays above it.
    """
    return combined.join(users, "user_id")


def summary_columns() -> dict[str, Column]:
    """Derived ratios on top of `measures`."""
    c = F.col
    return {
        "per_buyer": rounded(per(c("gmv"), c("buyers")), 0),
        "frequency": rounded(per(c("orders"), c("buyers")), 2),
        "new_share": rounded(percent(c("new_buyers"), c("buyers")), 1),
        "returning_share": rounded(percent(c("returning_buyers"), c("buyers")), 1),
        "new_per_buyer": rounded(per(c("new_gmv"), c("new_buyers")), 0),
        "returning_per_buyer": rounded(per(c("returning_gmv"), c("returning_buyers")), 0),
    }


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Money as double, for output."""
    return df.withColumns({c: amount(F.col(c)) for c in columns})


#: Bits of a filter of users: as many machine words of 64 as one scalar may well hold (1 MB).
FILTER_BITS = 1 << 23


def maybe_in(users: DataFrame, bits: int = FILTER_BITS, column: str = "user_id") -> Column:
    """True for every `user_id` (or other column) that `users` holds, and false for most others.

    A table of hashed bits, one for each user, is made in one pass over `users` and handed to
    every task of the scan that applies it, so that rows of other users go before they are
    combined and shuffled. Its size is fixed. With more users than bits it lets nearly all
    rows through, so an exact join has to follow.
    """
    spark, words = users.sparkSession, bits // 64
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    set_bits = users.where(F.col(column).isNotNull()).select(
        F.shiftright(place, 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    every = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    table = set_bits.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    packed = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    word = F.get(packed.scalar(), F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1
