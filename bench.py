"""Timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`preprocess` is the whole batch job, from untidy CSV files to stored tables.
`relabel` computes labels, ranks and pairs under other parameters, all columns.
The other entries are reports on the stored tables.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks import queries as registered
from repeatwise.plans import (
    channel, crowds, discount, flow, kpi, members, product, repurchase, rfm, samples,
    source_trace, trend,
)
from repeatwise.plans.build import build, relabel
from repeatwise.schema import LabelRule, SOURCE_COLUMNS, Scope
from repeatwise.session import local_session
from repeatwise.sources import landing, star

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
YEAR, TARGET, COUPONS = registered.YEAR, registered.TARGET, registered.COUPONS
# Statuses in the untidy text are the single letters of the source.
RULE = LabelRule(20000, 1, 365, (), ("F", "O"))
OTHER = LabelRule(40000, 30, 180, (), ("F", "O"))


def deliver(spark, folder: str) -> None:
    """Untidy CSV files as a landing zone would receive them."""
    def write(df, name):
        df = df.drop("_pos").withColumnsRenamed(SOURCE_COLUMNS)
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

    write(star.raw_orders(spark, SF), "orders")
    write(star.raw_samples(spark, SF), "samples")
    write(star.raw_members(spark, SF), "members")
    write(star.raw_crowds(spark, SF), "crowds")


def main() -> None:
    spark = local_session(CPUS, int(CPUS), memory="12g", app="bench")
    work = tempfile.mkdtemp(prefix="bench-")
    spark.sparkContext.setCheckpointDir(f"{work}/checkpoint")
    deliver(spark, f"{work}/landing")
    times: dict[str, float] = {}

    def clock(name, f):
        start = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    keywords = {n: n for n in ("orders", "samples", "members", "crowds")}
    t = clock("preprocess", lambda: build(spark, f"{work}/landing", f"{work}/tables", RULE, keywords))

    def both(tables):
        run(tables.orders)
        run(tables.pairs)

    clock("l5_relabel", lambda: run(relabel(t, OTHER).orders))
    clock("l5_relabel_orders_and_pairs", lambda: both(relabel(t, OTHER)))
    clock("l4_l8_star_labels_and_pairs", lambda: run(registered.Q["l8_purchase_pairs"](spark, SF)))
    clock("c8_dedup", lambda: run(registered.clean.clean_orders(
        landing.load_landing(spark, f"{work}/landing", "orders"))))
    users = lambda: rfm.rfm_users(t.orders, YEAR, RULE, m_buckets=registered.M_BUCKETS)
    reports = {
        "k1_kpi": lambda: kpi.kpi(t.orders, YEAR),
        "k2_kpi_delta": lambda: kpi.kpi_compare(t.orders, YEAR),
        "k3_channel_summary": lambda: channel.channel_summary(t.orders, YEAR),
        "k5_influencer_change": lambda: channel.channel_change(t.orders, YEAR, "influencer_name"),
        "t1_trend_daily_buyers": lambda: trend.trend(t.orders, Scope(), metric="buyers"),
        "t7_trend_periods": lambda: trend.trend_periods(t.orders, Scope()),
        "p1_product_rank": lambda: product.product_rank(t.orders, Scope(), "buyers"),
        "p3_product_table": lambda: product.product_table(t.orders, Scope()),
        "r1_cycle": lambda: repurchase.repurchase_cycle(t, Scope(), "sku"),
        "r3_rate": lambda: repurchase.repurchase_rate(t, Scope()),
        "r4_destinations": lambda: repurchase.repurchase_destinations(t, Scope()),
        "r5_monthly_rate": lambda: repurchase.repurchase_monthly(t, Scope()),
        "r6_by_channel": lambda: repurchase.repurchase_by_channel(t, Scope()),
        "m3_rfm_users": users,
        "m9_rfm_table": lambda: rfm.rfm_table(users(), "r", rfm.R_BUCKETS, rfm.cutoff(YEAR)),
        "m11_rfm_cross": lambda: rfm.rfm_cross(users()),
        "w2_flow": lambda: flow.flow_links(t, Scope()),
        "o5_source_trace": lambda: source_trace.history_by_influencer(t.orders, YEAR, TARGET),
        "d2_coupon_stats": lambda: discount.coupon_stats(t.orders, Scope(), COUPONS),
        "d4_subsidy_totals": lambda: discount.subsidy_totals(t.orders, Scope(), COUPONS),
        "d7_order_detail": lambda: discount.subsidy_orders(t.orders, YEAR, COUPONS, preview=500),
        "a5_sample_kpi": lambda: samples.sample_kpi(t, YEAR, RULE),
        "a9_sample_detail": lambda: samples.sample_detail(t, YEAR, RULE),
        "b3_member_compare": lambda: members.member_compare(t, Scope()),
        "u2_crowd_compare": lambda: crowds.crowd_compare(t, Scope()),
    }
    for name, f in reports.items():
        clock(name, lambda f=f: run(f()))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"),
        "stored_orders": t.orders.count()}))


if __name__ == "__main__":
    main()
