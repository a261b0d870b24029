"""The batch job: landing zone to stored tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession

from ..operators.clean import (
    LINEAGE, PROBLEMS, clean_crowds, clean_members, clean_orders, clean_samples, rejected, with_made, without_made,
)
from ..operators.journey import journey, pairs, without_journey
from ..operators.skew import hot_users
from ..schema import FILE_KEYWORDS, LabelRule, ORDER_COLUMNS, SAMPLE_COLUMNS, SourceMissing, Tables
from ..session import shared_folder
from ..sources.landing import load_zone
from ..sources.store import FORMAT, load, remove, save

REPORT = "source string, measure string, n_rows long"


def assemble(orders: DataFrame, rule: LabelRule = LabelRule(), hot: tuple[str, ...] = (),
             **optional: DataFrame | None) -> Tables:
    """Bundle of labelled orders, their pairs and whatever else is there."""
    journeys = journey(orders, rule, hot)
    return Tables(orders=journeys, pairs=pairs(journeys), hot_users=hot, **optional)


def relabel(tables: Tables, rule: LabelRule) -> Tables:
    """The same bundle under another rule; pairs follow their orders."""
    shared_folder(tables.orders.sparkSession)  # large users need it: no later surprise
    base = without_journey(tables.orders)
    again = assemble(base, rule, tables.hot_users)
    return replace(tables, orders=again.orders, pairs=again.pairs)


def build(spark: SparkSession, landing: str, out: str, rule: LabelRule = LabelRule(),
          keywords: dict[str, str] = FILE_KEYWORDS, with_pairs: bool = False,
          strict: bool = True, with_rejected: bool = False) -> Tables:
    """Clean, label and store everything a landing zone holds.

    Cleaned orders are written once and read back, so de-duplication is not repeated
    for the user count and the labelled orders; that copy is removed in the end. The
    stored orders hold each order's successor, from which pairs are read without another
    shuffle. Whatever the data, `spark.checkpoint.dir` must be there on a cluster, as
    users too large for one task need it.

    How many rows of orders and samples were read, dropped for each reason, dropped as
    copies and kept is counted on the way and stored as `report`. Not `strict`, rows whose amount
    is out of range are dropped and counted instead of an error. `with_rejected` also
    stores the dropped rows, as delivered, with the reason; that reads the orders once more.
    """
    shared_folder(spark)
    raw = load_zone(spark, landing, keywords)
    if raw["orders"] is None:
        raise SourceMissing(keywords["orders"])
    staged = f"{out}/_cleaned_orders"
    tallies = {"orders": Observation("orders")}
    cleaned = clean_orders(raw["orders"], strict=strict, tally=tallies["orders"])
    without_made(cleaned).write.mode("overwrite").options(**FORMAT).parquet(staged)
    orders = spark.read.parquet(staged)
    hot = hot_users(orders)
    # Dealt by user as the journey needs it, before columns are added; users too large for one task must not be.
    orders = with_made(orders if hot else orders.repartition("user_id"))
    optional = {}
    if raw.get("samples") is not None:
        tallies["samples"] = Observation("samples")
        optional["samples"] = clean_samples(raw["samples"], strict, tallies["samples"])
    cleaners = {"members": clean_members, "crowds": clean_crowds}
    optional |= {name: f(raw[name]) for name, f in cleaners.items() if raw.get(name) is not None}
    save(assemble(orders, rule, hot, **optional), out, with_pairs)
    remove(spark, staged)
    tables = load(spark, out)
    _report(spark, out, tables, tallies)
    if with_rejected:
        for name, columns in (("orders", ORDER_COLUMNS), ("samples", SAMPLE_COLUMNS)):
            if raw.get(name) is not None:
                rows = rejected(raw[name], columns, rowwise_time=name == "samples").drop(*LINEAGE)
                rows.write.mode("overwrite").parquet(f"{out}/rejected/{name}")
    return tables


def counted(tallies: dict[str, Observation], kept: dict[str, int]) -> list[tuple[str, str, int]]:
    """Rows of a report: what was seen, dropped for each reason, dropped as a copy and kept."""
    rows = []
    for name, tally in tallies.items():
        found = tally.get
        copies = found["rows read"] - sum(found[reason] for reason in PROBLEMS) - kept[name]
        rows += [(name, measure, n) for measure, n in (*found.items(), ("copies", copies), ("kept", kept[name]))]
    return rows


def _report(spark: SparkSession, out: str, tables: Tables, tallies: dict[str, Observation]) -> None:
    """Rows read, dropped and kept, one number a row: (source, measure, n_rows)."""
    rows = counted(tallies, {name: getattr(tables, name).count() for name in tallies})
    spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("overwrite").json(f"{out}/report")


def build_report(spark: SparkSession, path: str) -> DataFrame:
    """What the build that wrote the tables in `path` read, dropped and kept."""
    return spark.read.schema(REPORT).json(f"{path}/report")
