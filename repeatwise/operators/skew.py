"""Users with too many rows for one task.

Sequence operators order the rows of each user, so a user's rows meet in one task.
A placeholder id can own a large part of all rows. Such users are found by an exact
count and handled by plans that cut their rows into ranges. Reports need no such
care: they combine each user's rows before joining on the user.

A user is hot when it owns more than `share` of all rows (and more than `floor`
rows). Fewer than 1/share users can be hot, whatever the data, so the list is safe
to hold on the driver and to broadcast. At a trillion rows the default leaves at
most ten million rows of one user to a task; the windows there take in each row once, so
their cost is that of the sort, which can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.00001
FLOOR = 1_000_000
# Up to this many ids go into the plan as literals, which a scan can use.
LITERALS = 1000


def hot_users(orders: DataFrame, share: float = SHARE, floor: int = FLOOR,
              total: int | None = None) -> tuple[str, ...]:
    """Users owning more than max(share of all rows, floor) rows.

    `total` is the number of all rows, where `orders` holds only those of some users.
    """
    counts = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # Both uses of `counts` share one exchange.
    rows = counts.agg(F.sum("n").alias("total")).scalar() if total is None else F.lit(total)
    limit = F.greatest(F.lit(float(floor)), rows * F.lit(share))
    return tuple(r.user_id for r in counts.where(F.col("n") > limit).select("user_id").collect())


def split(df: DataFrame, hot: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary users and rows of hot users."""
    if len(hot) <= LITERALS:
        is_hot = F.col("user_id").isin(*hot)
        return df.where(~is_hot), df.where(is_hot)
    few = F.broadcast(df.sparkSession.createDataFrame([(u,) for u in hot], "user_id string"))
    return df.join(few, "user_id", "left_anti"), df.join(few, "user_id", "left_semi")
