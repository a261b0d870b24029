"""From all-string landing rows to typed, de-duplicated tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import clean_text, read_money, read_time, strip
from ..schema import (
    CROWD_COLUMNS, CROWD_TEXT, ID_TOKENS, MEMBER_COLUMNS, MONEY, ORDER_COLUMNS,
    ORDER_TEXT, SAMPLE_COLUMNS, SAMPLE_TEXT, SOURCE_COLUMNS,
)
from .people import maybe_in

# Where a landing row came from; decides which of several copies is the first.
LINEAGE = ("_file", "_pos")


def rename_and_keep(raw: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Logical names, allowed columns only; lineage stays for de-duplication."""
    named = raw.withColumnsRenamed({v: k for k, v in SOURCE_COLUMNS.items()})
    keep = [c for c in (*columns, *LINEAGE) if c in named.columns]
    return named.select(*keep)


def stripped(df: DataFrame) -> DataFrame:
    """All texts without white space at their ends, in a projection of its own.

    What follows names a text several times; the optimizer leaves a projection alone whose
    costly columns are used more than once, so that each is stripped once.
    """
    return df.withColumns({c: strip(F.col(c)) for c in df.columns if c not in LINEAGE})


def fill_text(df: DataFrame, rules: dict) -> DataFrame:
    """Normalise text columns; an absent column becomes its default throughout."""
    return df.withColumns({
        c: clean_text(c, tokens, default) if c in df.columns else F.lit(default)
        for c, (tokens, default) in rules.items()
    })


def keep_first(df: DataFrame, keys: dict[str, Column], order: list[str],
               columns: list[str] | None = None) -> DataFrame:
    """First row per key in the given order, with all or the given columns.

    An aggregate rather than a window: copies are combined before the shuffle, so a
    key repeated any number of times sends one row per input partition.
    """
    columns = columns or df.columns
    keyed = df.withColumns(keys)
    first = keyed.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def _id_or_fallback(fallback: tuple[str, ...]) -> dict[str, Column]:
    has_id = F.col("sub_order_id") != ""
    keys = {"_key_id": F.when(has_id, F.col("sub_order_id"))}
    keys |= {f"_key_{c}": F.when(~has_id, F.col(c)) for c in fallback}
    return keys


def _first_order(df: DataFrame) -> list[str]:
    lineage = [c for c in LINEAGE if c in df.columns]
    return lineage or sorted(df.columns)


def _pay_time(df: DataFrame, rowwise: bool) -> DataFrame:
    """Parse both times and fall back to the submit time.

    Row by row if `rowwise`; otherwise only when no row at all has a pay time. Only then
    a test runs, which reads a single column and stops at the first hit.
    """
    nothing = F.lit(None).cast("timestamp_ntz")
    pay = read_time(F.col("pay_time")) if "pay_time" in df.columns else nothing
    submit = read_time(F.col("order_submit_time")) if "order_submit_time" in df.columns else nothing
    if rowwise or "pay_time" not in df.columns:
        chosen = F.coalesce(pay, submit)
    else:
        # Empty texts are passed over before any is parsed.
        some = df.where((F.col("pay_time") != "") & pay.isNotNull())
        chosen = F.when(some.exists(), pay).otherwise(submit)
    return df.withColumns({"pay_time": chosen, "order_submit_time": submit})


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "order_date": F.col("pay_time").cast("date"),
        "order_ym": F.date_format("pay_time", "yyyy-MM"),
    })


def _money(df: DataFrame, strict: bool = True) -> DataFrame:
    if "payable_amount" in df.columns:
        value = read_money(F.col("payable_amount"), strict)
    else:
        value = F.lit(0).cast(MONEY)
    return df.withColumns({"payable_amount": value, "gmv": value})


# Why a row can't be used, in the order of precedence; and the column whose value is missing then.
PROBLEMS = {"no readable time": "pay_time", "no user": "user_id", "amount out of range": "gmv"}


def _problem() -> Column:
    out = F.lit(None).cast("string")
    for reason, column in reversed(PROBLEMS.items()):
        out = F.when(F.col(column).isNull(), reason).otherwise(out)
    return out


def _usable(df: DataFrame, tally: Observation | None) -> DataFrame:
    """Rows with a time, a user and an amount; `tally` counts the others in the same pass."""
    if tally:
        reason = _problem()
        df = df.observe(tally, F.count(F.lit(1)).alias("rows read"),
                        *[F.count_if(reason == r).alias(r) for r in PROBLEMS])
    return df.dropna(subset=list(PROBLEMS.values()))


def normalise_orders(raw: DataFrame, rowwise_time: bool = False, strict: bool = True,
                     tally: Observation | None = None) -> DataFrame:
    """Everything `clean_orders` does short of de-duplication."""
    df = _money(_pay_time(stripped(rename_and_keep(raw, ORDER_COLUMNS)), rowwise_time), strict)
    df = _dates(fill_text(_usable(df, tally), ORDER_TEXT))
    return fill_text(df, {"sub_order_id": (("nan", "None"), "")})


# What tells one row of a table without an id from another.
FALLBACK_KEYS = {"orders": ("user_id", "pay_time", "sku", "influencer_name"),
                 "samples": ("user_id", "pay_time", "sku", "sample_type")}


# Columns that are made of another one, so that only that one is shuffled.
_MADE_OF = {"payable_amount": "gmv", "order_date": "pay_time", "order_ym": "pay_time"}


def without_made(orders: DataFrame) -> DataFrame:
    """Cleaned orders without the columns that `with_made` makes of others."""
    return orders.drop(*_MADE_OF)


def with_made(orders: DataFrame) -> DataFrame:
    return _dates(orders.withColumn("payable_amount", F.col("gmv")))


def _first_of_each(df: DataFrame, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The first of each order or sample, with all or the given columns.

    The optimizer doesn't prune what an aggregate carries, so nothing else goes into it.
    """
    wanted = [c for c in columns or df.columns if c not in LINEAGE]
    carried = list(dict.fromkeys(_MADE_OF.get(c, c) for c in wanted))
    first = keep_first(df, _id_or_fallback(FALLBACK_KEYS[name]), _first_order(df), carried)
    if "gmv" in carried:
        first = first.withColumn("payable_amount", F.col("gmv"))
    return (_dates(first) if "pay_time" in carried else first).select(*wanted)


def without_copies(new: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """Cleaned rows of `new` of which `stored`, cleaned as well, holds no copy.

    Only stored rows whose key may be among the new ones leave the scan.
    """
    keys = _id_or_fallback(FALLBACK_KEYS[name])
    key = F.to_json(F.struct(*[k.alias(n) for n, k in keys.items()])).alias("_key")
    keyed = new.withColumn("_key", key)
    known = stored.select(key).where(maybe_in(keyed, column="_key"))
    return keyed.join(known, "_key", "left_anti").drop("_key")


def clean_orders(raw: DataFrame, rowwise_time: bool = False, strict: bool = True,
                 tally: Observation | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Orders, one of each; an amount out of range is an error, or drops its row if not `strict`.

    `columns` are those wanted, if not all; the others are then not shuffled.
    """
    return _first_of_each(normalise_orders(raw, rowwise_time, strict, tally), "orders", columns)


def clean_samples(raw: DataFrame, strict: bool = True, tally: Observation | None = None) -> DataFrame:
    """Samples; unlike orders a missing pay time is filled row by row."""
    df = _money(_pay_time(stripped(rename_and_keep(raw, SAMPLE_COLUMNS)), rowwise=True), strict)
    df = _dates(fill_text(_usable(df, tally), SAMPLE_TEXT))
    df = fill_text(df, {"sub_order_id": (("nan", "None"), "")})
    return _first_of_each(df, "samples")


def rejected(raw: DataFrame, columns: tuple[str, ...], rowwise_time: bool = False) -> DataFrame:
    """Rows of orders or samples (`columns` are theirs) that cleaning drops, as delivered, and why."""
    named = rename_and_keep(raw, columns)
    texts = {c: strip(F.col(c)) for c in named.columns if c not in LINEAGE}
    kept = named.withColumn("_raw", F.struct(*named.columns)).withColumns(texts)
    parsed = _money(_pay_time(kept, rowwise_time), strict=False)
    return parsed.withColumn("reason", _problem()).where(F.col("reason").isNotNull()).select("_raw.*", "reason")


def _with_user(raw: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a user; without the column there is none, and the table is empty."""
    df = stripped(rename_and_keep(raw, columns))
    if "user_id" not in df.columns:
        warnings.warn("no user column was delivered: the table is empty", stacklevel=3)
        df = df.withColumn("user_id", F.lit(None).cast("string"))
    return df.where(F.col("user_id").isNotNull() & ~F.col("user_id").isin(*ID_TOKENS))


def clean_members(raw: DataFrame) -> DataFrame:
    """One row per member with the earliest readable join time, if any."""
    df = _with_user(raw, MEMBER_COLUMNS)
    joined = read_time(F.col("join_time")) if "join_time" in df.columns \
        else F.lit(None).cast("timestamp_ntz")
    members = df.groupBy("user_id").agg(F.min(joined).alias("join_time"))
    return members.withColumn("join_ym", F.date_format("join_time", "yyyy-MM"))


def clean_crowds(raw: DataFrame) -> DataFrame:
    df = fill_text(_with_user(raw, CROWD_COLUMNS), CROWD_TEXT)
    return df.select("crowd_name", "user_id").distinct()
