"""Retail tables derived from a star schema of orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.median import exact_median
from ..schema import MONEY

EPOCH = "TIMESTAMP_NTZ'1995-01-01 00:00:00'"


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _joined(spark: SparkSession, path: str, lines: DataFrame, orders_last: bool = False) -> DataFrame:
    """Line items with order, part, supplier and region; join sides by size.

    One table after the other: of a join of the small ones Spark can't tell the size, takes
    it for large, and shuffles all line items by supplier. With `orders_last` rows leave the joins as
    dealt by order, if that is how orders are joined.
    """
    read = lambda n: _read(spark, path, n)
    sides = [
        (read("part"), F.col("l_partkey") == F.col("p_partkey")),
        (read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")),
        (read("nation"), F.col("s_nationkey") == F.col("n_nationkey")),
        (read("region"), F.col("n_regionkey") == F.col("r_regionkey")),
    ]
    sides.insert(len(sides) if orders_last else 0, (read("orders"), F.col("l_orderkey") == F.col("o_orderkey")))
    for table, same in sides:
        lines = lines.join(table, same)
    return lines


LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def _first_lines(lines: DataFrame) -> DataFrame:
    """One row of each line item, the first in the order of `LINE_ORDER`.

    Rows are dealt by order alone, so that the join with orders needs no further shuffle.
    """
    keys = ["l_orderkey", "l_linenumber"]
    row = F.struct(*LINE_ORDER, *[c for c in lines.columns if c not in (*keys, *LINE_ORDER)])
    return lines.repartition("l_orderkey").groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, "_row.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag",
        "l_shipdate", "l_partkey", "l_suppkey")


def _discount_text() -> Column:
    line = F.col("l_linenumber").cast("string")
    return F.when(
        F.col("l_discount") >= 0.05,
        F.concat(F.lit("PLAT-"), "l_returnflag", F.lit("-1,2"), line, F.lit("0.50;SHOP-"),
                 line, F.lit("; junk"))).otherwise(F.lit(""))


def _pay_time() -> Column:
    return F.col("o_orderdate") + F.make_dt_interval(
        F.lit(0), F.col("l_linenumber") * 3, F.lit(0), F.lit(0))


def _user() -> Column:
    return F.col("o_custkey").cast("string")


def _columns() -> list[Column]:
    gmv = F.col("l_extendedprice").cast(MONEY)
    time = _pay_time()
    status = F.col("o_orderstatus")
    return [
        _user().alias("user_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("sub_order_id"),
        F.col("p_brand").alias("sku"),
        F.col("s_name").alias("influencer_name"),
        F.when(status == "F", F.lit("completed")).when(status == "O", F.lit("shipped"))
        .otherwise(F.lit("closed")).alias("order_status"),
        F.col("l_returnflag").alias("after_sale_status"),
        gmv.alias("payable_amount"),
        time.alias("pay_time"),
        F.col("o_orderdate").alias("order_submit_time"),
        F.col("p_type").alias("category"),
        F.when(F.col("r_regionkey").isin(0, 1), F.lit("self"))
        .otherwise(F.lit("influencer")).alias("channel_type"),
        _discount_text().alias("platform_discount"),
        gmv.alias("gmv"),
        time.cast("date").alias("order_date"),
        F.date_format(time, "yyyy-MM").alias("order_ym"),
    ]


def retail_orders(spark: SparkSession, path: str, by_user: bool = False) -> DataFrame:
    """Cleaned orders; repeated line items are reduced before anything is joined.

    With `by_user` rows are dealt by user before their texts are made, so that what needs all orders
    of a user together shuffles keys and numbers instead.
    """
    rows = _joined(spark, path, _first_lines(_lines(spark, path)))
    return (rows.repartition(_user()) if by_user else rows).select(*_columns())


def most_rows_of_user(spark: SparkSession, path: str) -> int:
    """No user owns more rows of `retail_orders`; repeated line items count as often as they come.

    From counts alone, which are combined before they are shuffled.
    """
    read = lambda n: _read(spark, path, n)
    most = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    place = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = lines.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .groupBy("o_custkey").agg(F.sum("n").alias("n"))
    # Keys that come twice in the tables of parts and suppliers double rows.
    bound = F.max("n") * most(read("part"), "p_partkey") * most(place, "s_suppkey")
    return rows.agg(bound.alias("n")).first().n or 0


def retail_samples(orders: DataFrame) -> DataFrame:
    return orders.where((F.col("after_sale_status") == "R") & (F.col("gmv") < 8000)).select(
        "user_id", "sub_order_id", F.col("category").alias("sample_type"), "sku",
        F.col("sku").alias("product_name"), F.lit("unknown").alias("merchant_code"),
        "order_status", "payable_amount", "pay_time", "order_submit_time", "gmv",
        "order_date", "order_ym")


def retail_members(spark: SparkSession, path: str) -> DataFrame:
    joined = F.expr(EPOCH) + F.make_dt_interval((F.col("c_custkey") % 2400).cast("int"))
    return (
        _read(spark, path, "customer").where(F.col("c_acctbal") > 0)
        .select(F.col("c_custkey").cast("string").alias("user_id"), joined.alias("join_time"))
        .withColumn("join_ym", F.date_format("join_time", "yyyy-MM"))
    )


def retail_crowds(spark: SparkSession, path: str) -> DataFrame:
    user = F.col("c_custkey").cast("string")
    names = F.array(F.col("c_mktsegment"),
                    F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return _read(spark, path, "customer").select(
        F.explode(names).alias("crowd_name"), user.alias("user_id"))


# Untidy text versions of the same rows, as a landing zone would hold them.

def raw_orders(spark: SparkSession, path: str) -> DataFrame:
    """All-string orders with padding, missing-value tokens, bad numbers and copies."""
    return _untidy(_joined(spark, path, _lines(spark, path)))


def middle_order(spark: SparkSession, path: str) -> float | None:
    """Median order number of the rows of `raw_orders`, to deliver them in two halves."""
    # Rows leave the joins as dealt by order, and are counted by order without another shuffle.
    return exact_median(_joined(spark, path, _lines(spark, path), orders_last=True), "l_orderkey")


def raw_deliveries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `raw_orders` as they are to be written: of copies, the first by `_pos` comes first.

    Rows with an id have copies in their own order only. They stay where the join with orders
    brought them and are sorted there. Only those without one, which may be copies of any other,
    are sorted as a whole.
    """
    lines = _lines(spark, path)
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    has_id = F.coalesce(key % 13 != 0, F.lit(False)) & line.isNotNull()
    # A window, as it holds the rows of an order together whatever Spark makes of the joins.
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", *LINE_ORDER))
    named = _joined(spark, path, lines.where(has_id), orders_last=True).withColumn("_place", place)
    return (_untidy(named.where(F.col("_place") > 0)),
            _untidy(_joined(spark, path, lines.where(~has_id))).orderBy("_pos"))


def _untidy(rows: DataFrame) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    user = F.col("o_custkey").cast("string")
    number = F.col("l_extendedprice").cast(MONEY).cast("string")
    time = _pay_time()
    sub_id = F.concat(key.cast("string"), F.lit("-"), line.cast("string"))
    lit = F.lit
    columns = {
        "user_id": F.when((line == 7) & (key % 10 == 0), lit(None))
        .when(key % 11 == 0, F.concat(lit("  "), user, lit(" ")))
        .when(key % 11 == 1, F.concat(lit("\t"), user, lit("\u3000\xa0\n"))).otherwise(user),
        "sub_order_id": F.when(
            key % 13 == 0,
            F.when(line % 4 == 0, lit("")).when(line % 4 == 1, lit("nan"))
            .when(line % 4 == 2, lit("None"))).otherwise(sub_id),
        "sku": F.when((line == 2) & (key % 5 == 0), lit("nan"))
        .when((line == 3) & (key % 7 == 0), lit("  ")).when((line == 3) & (key % 7 == 1), lit("\t\u2003"))
        .otherwise(F.concat(lit(" "), F.col("p_brand"))),
        "influencer_name": F.when((line == 4) & (key % 3 == 0), lit(None))
        .otherwise(F.col("s_name")),
        "order_status": F.when(key % 17 == 0, lit("")).otherwise(F.col("o_orderstatus")),
        "after_sale_status": F.when(line == 1, lit("-")).when(line == 2, lit("None"))
        .when(line == 3, lit("nan")).when(line == 4, lit("")).otherwise(F.col("l_returnflag")),
        "payable_amount": F.when(key % 19 == 0, lit("12d")).when(key % 19 == 1, lit("1,000"))
        .when(key % 19 == 2, lit(" 123.45 ")).when(key % 19 == 3, lit("1.5e3"))
        .when(key % 19 == 4, F.concat(lit("\xa0"), number, lit("\t"))).otherwise(number),
        "pay_time": F.when(key % 23 == 0, lit("bad")).when(key % 23 == 1, lit(None))
        .when(key % 23 == 2, F.date_format(time, "yyyy/M/d H:mm"))
        .when(key % 23 == 3, F.date_format(time, "yyyyMMdd HH:mm:ss"))
        .when(key % 23 == 4, F.date_format(time, "yyyy.M.d"))
        .when(key % 23 == 5, F.date_format(time, "yyyy-MM-dd  h:mm:ss a"))
        .otherwise(F.date_format(time, "yyyy-MM-dd HH:mm:ss")),
        "order_submit_time": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        "category": F.when(line == 5, lit("nan")).otherwise(F.col("p_type")),
        "channel_type": F.when(line == 6, lit("")).when(F.col("r_regionkey").isin(0, 1), lit("self"))
        .otherwise(lit("influencer")),
        "platform_discount": F.when(line == 1, lit("-")).otherwise(_discount_text()),
        "_pos": F.struct("l_orderkey", "l_linenumber", *LINE_ORDER),
    }
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def raw_samples(spark: SparkSession, path: str) -> DataFrame:
    """Untidy samples: the cheap returned lines of `raw_orders`."""
    raw = raw_orders(spark, path)
    return raw.where(F.col("payable_amount").isin("12d", " 123.45 ", "1.5e3")).withColumns({
        "sample_type": F.col("category"),
        "product_name": F.col("sku"),
        "merchant_code": F.col("after_sale_status"),
    })


def raw_members(spark: SparkSession, path: str) -> DataFrame:
    """Untidy members: one row per order, so the same member joins repeatedly."""
    custkey, orderkey = F.col("o_custkey"), F.col("o_orderkey")
    user = custkey.cast("string")
    return _read(spark, path, "orders").select(
        F.when(orderkey % 29 == 0, F.lit("nan")).when(orderkey % 29 == 1, F.lit(" "))
        .when(orderkey % 29 == 2, F.concat(F.lit(" "), user)).otherwise(user).alias("user_id"),
        F.when((custkey % 7 == 0) | (orderkey % 5 == 0), F.lit("-"))
        .when(orderkey % 5 == 1, F.date_format("o_orderdate", "yyyy/M/d"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("join_time"))


def raw_crowds(spark: SparkSession, path: str) -> DataFrame:
    """Untidy crowds: one row per order, named by priority, with repeats."""
    custkey, orderkey = F.col("o_custkey"), F.col("o_orderkey")
    return _read(spark, path, "orders").select(
        F.when(orderkey % 31 == 0, F.lit("None")).when(orderkey % 31 == 1, F.lit(" "))
        .otherwise(F.concat("o_orderpriority", F.lit(" "))).alias("crowd_name"),
        F.when(orderkey % 37 == 0, F.lit("")).otherwise(custkey.cast("string")).alias("user_id"))
