"""Platform discount text: `name-amount;name-amount`.

The pieces of an order are an array on its own row, so what an order received is a
row expression; nothing has to be joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip, to_money
from ..schema import MONEY

# Fixed value: a name, a dash and a number that may have thousands commas.
COUPON = r"^(.+)-([\d,]+(?:\.\d+)?)$"


def coupon_array() -> Column:
    """Readable pieces as array<struct<coupon, amount>>, in text order."""
    pieces = F.transform(F.split("platform_discount", ";"), strip)
    parsed = F.transform(
        F.filter(pieces, lambda p: p.rlike(COUPON)),
        lambda p: F.struct(
            strip(F.regexp_extract(p, COUPON, 1)).alias("coupon"),
            to_money(F.nullif(F.replace(F.regexp_extract(p, COUPON, 2), F.lit(","), F.lit("")), F.lit("")))
            .alias("amount")))
    return F.filter(parsed, lambda c: c["amount"].isNotNull())


def chosen(coupons: Column, selected: tuple[str, ...]) -> Column:
    if not selected:
        return F.filter(coupons, lambda c: F.lit(False))
    return F.filter(coupons, lambda c: c["coupon"].isin(*selected))


def total(coupons: Column) -> Column:
    return F.aggregate(
        coupons, F.lit(0).cast(MONEY), lambda acc, c: (acc + c["amount"]).cast(MONEY))


def order_key() -> Column:
    """Identifies an order, also one without a sub-order id."""
    other = F.concat_ws("|", "user_id", F.col("pay_time").cast("string"), "sku", "influencer_name")
    return F.when(F.col("sub_order_id") != "", F.col("sub_order_id")).otherwise(other)


def coupons(orders: DataFrame) -> DataFrame:
    """One row per readable piece: order, position in the text, name, amount."""
    return (
        orders.select(order_key().alias("order_key"), F.posexplode(coupon_array()).alias("pos", "c"))
        .select("order_key", F.col("pos").cast("long").alias("pos"), "c.coupon", "c.amount")
    )


def with_subsidy(orders: DataFrame, selected: tuple[str, ...]) -> DataFrame:
    """Orders with the amount and text of the selected coupons, and the real income."""
    picked = chosen(coupon_array(), selected)
    text = F.array_join(F.transform(picked, lambda c: F.concat(
        c["coupon"], F.lit("("), c["amount"].cast("string"), F.lit(")"))), "; ")
    return orders.withColumns({"subsidy": total(picked), "coupon_text": text}).withColumn(
        "real_income", F.col("gmv") + F.col("subsidy"))
