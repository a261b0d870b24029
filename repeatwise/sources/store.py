"""Cleaned tables on disk, their catalogue, and CSV exports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.journey import pairs
from ..schema import Tables

# Partition column of each stored table; months keep date filters cheap.
PARTITION = {"orders": "order_ym", "pairs": "from_ym", "samples": "order_ym"}
DIMENSIONS = ("sku", "influencer_name", "order_status", "after_sale_status",
              "category", "channel_type")
# Stored tables are compressed further than by default, as they are written once and read often.
FORMAT = {"compression": "zstd"}
#: Bytes of a month from which on it gets a further file.
FILE_BYTES = 1 << 27
#: Months whose files are brought together at once, by a Spark job each.
MONTHS_AT_ONCE = 16
LINKS = (("channel_type", "influencer_name"), ("category", "sku"))

SCHEMAS = {
    "orders": "user_id string, sub_order_id string, sku string, influencer_name string, "
              "order_status string, after_sale_status string, payable_amount decimal(18,2), "
              "pay_time timestamp_ntz, order_submit_time timestamp_ntz, category string, "
              "channel_type string, platform_discount string, gmv decimal(18,2), "
              "order_date date, order_ym string, purchase_rank bigint, "
              "first_qualify_time timestamp_ntz, first_qualify_influencer string, "
              "first_qualify_sku string, first_qualify_gmv decimal(18,2), "
              "customer_type_lifetime string, customer_type string, "
              "next_pay_time timestamp_ntz, next_order_ym string, next_order_date date, "
              "next_influencer_name string, next_sku string, next_gmv decimal(18,2), "
              "next_order_status string, next_category string, next_channel_type string",
    "pairs": "user_id string, customer_type string, customer_type_lifetime string, "
             + ", ".join(
                 f"{side}_ym string, {side}_date date, {side}_influencer string, "
                 f"{side}_sku string, {side}_rank bigint, {side}_gmv decimal(18,2), "
                 f"{side}_status string, {side}_category string, {side}_channel_type string"
                 for side in ("from", "to"))
             + ", days_between bigint",
    "samples": "user_id string, sub_order_id string, sample_type string, sku string, "
               "product_name string, merchant_code string, order_status string, "
               "payable_amount decimal(18,2), pay_time timestamp_ntz, "
               "order_submit_time timestamp_ntz, gmv decimal(18,2), order_date date, "
               "order_ym string",
    "members": "user_id string, join_time timestamp_ntz, join_ym string",
    "crowds": "crowd_name string, user_id string",
}


def save(tables: Tables, path: str, with_pairs: bool = False) -> None:
    """Write every table that is there as Parquet, plus catalogue and extent.

    Stored orders carry their successor, and `load` reads pairs off them. A copy of
    the pairs is written on request only, for readers other than this package.
    """
    spark = tables.orders.sparkSession
    together(*[
        lambda df=df, name=name: _write_months(df, name, path) if name in PARTITION
        else _write(df, name, path, rebalance=True)
        for name in ("orders", "samples", "members", "crowds")
        if (df := getattr(tables, name)) is not None])
    orders = load_table(spark, path, "orders")
    hot = spark.createDataFrame([(u,) for u in tables.hot_users], "user_id string")
    together(
        *([lambda: _write(pairs(orders), "pairs", path)] if with_pairs else []),
        lambda: catalogue(orders).write.mode("overwrite").parquet(f"{path}/catalogue"),
        lambda: extent(orders).write.mode("overwrite").json(f"{path}/extent"),
        lambda: hot.write.mode("overwrite").parquet(f"{path}/hot_users"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this package has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def together(*jobs, at_once: int | None = None) -> None:
    """Start independent Spark jobs at once, so small ones fill gaps of large ones."""
    with ThreadPoolExecutor(at_once or len(jobs) or 1) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _write(df: DataFrame, name: str, path: str, rebalance: bool = False, **options: str) -> None:
    """The rebalance hint lets Spark even out file sizes."""
    month = PARTITION.get(name)
    df = _in_schema(df, name)
    if rebalance:
        df = df.hint("rebalance", month) if month else df.hint("rebalance")
    writer = df.write.partitionBy(month) if month else df.write
    writer.mode("overwrite").options(**FORMAT, **options).parquet(f"{path}/{name}")


def _in_schema(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in _columns_of(name) if c in df.columns]) if name in SCHEMAS else df


def _write_months(df: DataFrame, name: str, path: str) -> None:
    """A table laid out by month, without another shuffle of its rows.

    Tasks put their rows to the months themselves, beside the table, which makes a small file for each
    task and month. The files of a month are then read and written as few large ones, month by month: that
    costs the table's size on disk once more, where rows sent to their month cost several times that.
    """
    spark, month, out, staged = df.sparkSession, PARTITION[name], f"{path}/{name}", f"{path}/_{name}_by_task"
    df = _in_schema(df, name)
    df.write.partitionBy(month).mode("overwrite").options(**FORMAT).parquet(staged)
    rest = df.drop(month)
    remove(spark, out)

    def bring_together(folder: str, size: int) -> None:
        rows = spark.read.schema(rest.schema).parquet(f"{staged}/{folder}")
        rows.coalesce(-(-size // FILE_BYTES) or 1).write.options(**FORMAT).parquet(f"{out}/{folder}")

    together(*[lambda m=m: bring_together(*m) for m in _folders(spark, staged)], at_once=MONTHS_AT_ONCE)
    # No row: the folder of a table without any, and the mark of a complete one.
    df.limit(0).write.partitionBy(month).mode("append").parquet(out)
    remove(spark, staged)


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and bytes of each folder of a partitioned table: one a month."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(f.getPath().getName(), system.getContentSummary(f.getPath()).getLength())
            for f in system.listStatus(place) if f.isDirectory()]


def by_month(df: DataFrame, name: str) -> DataFrame:
    """Rows evened out over files of a month each, for `replace_months`."""
    return df.hint("rebalance", PARTITION[name])


def replace_months(df: DataFrame, name: str, path: str) -> None:
    """Put the months that `df` has rows of in place of the stored ones; others stay.

    Rows are written as they are laid out: stored ones as before, others go through `by_month`.
    """
    _write(df, name, path, partitionOverwriteMode="dynamic")


def replace_table(df: DataFrame, name: str, path: str) -> None:
    """Put `df` in place of a stored table as a whole."""
    _write(df, name, path, rebalance=name in SCHEMAS)


def _columns_of(name: str) -> list[str]:
    return [part.split()[0] for part in SCHEMAS[name].split(", ")]


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(spark: SparkSession, path: str) -> Tables:
    """Stored tables as a bundle; tables never written are None.

    Pairs are read off the stored orders, so filters on them prune months too.
    """
    found = {name: load_table(spark, path, name) for name in SCHEMAS if name != "pairs"}
    found["pairs"] = pairs(found["orders"])
    return Tables(hot_users=load_hot_users(spark, path), **found)


def load_hot_users(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(r.user_id for r in spark.read.schema("user_id string").parquet(f"{path}/hot_users").collect())


def catalogue(orders: DataFrame) -> DataFrame:
    """Values per dimension and linked values, one per row.

    `kind` names the dimension, `parent` the value it is listed under for the two
    links (influencers of a channel, skus of a category), else it is null.
    """
    entry = lambda kind, parent, value: F.struct(
        F.lit(kind).alias("kind"), parent.alias("parent"), F.col(value).alias("value"))
    none = F.lit(None).cast("string")
    entries = [entry(d, none, d) for d in DIMENSIONS]
    entries += [entry(f"{up}/{down}", F.col(up), down) for up, down in LINKS]
    # Entries rather than whole combinations, of which there may be as many as orders.
    return orders.select(F.inline(F.array(*entries))).distinct()


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue that `save` stored next to the tables: some rows for each value, none for each order."""
    return spark.read.schema("kind string, parent string, value string").parquet(f"{path}/catalogue")


def extent(orders: DataFrame) -> DataFrame:
    """Date range, largest amount, rows and users."""
    users = orders.groupBy("user_id").agg(
        F.min("order_date").alias("lo"), F.max("order_date").alias("hi"),
        F.max("gmv").alias("top"), F.count(F.lit(1)).alias("n"))
    return users.agg(
        F.min("lo").alias("date_min"), F.max("hi").alias("date_max"),
        F.max("top").cast("double").alias("gmv_max"),
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("total_users"))


def load_extent(spark: SparkSession, path: str) -> DataFrame:
    """The one row that `save` stored."""
    return spark.read.schema(
        "date_min date, date_max date, gmv_max double, total_rows long, total_users long").json(f"{path}/extent")


def export_csv(report: DataFrame, path: str) -> None:
    """Report as a folder of CSV files with header, texts as they are."""
    report.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
