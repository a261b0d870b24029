"""Report rules that plain examples show best; sums over real data are in test_queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from repeatwise.functions.columns import delta_percent, first_match, rounded
from repeatwise.operators.coupons import coupon_array, coupons, with_subsidy
from repeatwise.operators.scope import apply_scope, apply_two_scopes, choices, scope_pairs
from repeatwise.plans import (
    channel, crowds, discount, flow, kpi, members, product, repurchase, rfm, samples,
    source_trace, trend,
)
from repeatwise.plans.build import assemble
from repeatwise.schema import LabelRule, Scope, Tables

RULE = LabelRule(500, 1, 365, (), ("done",))


def at(month, day, hour=0, year=2024):
    return dt.datetime(year, month, day, hour)


@pytest.fixture(scope="module")
def t(make_orders, spark):
    rows = [
        ("a", at(1, 1), 600, "s1", "i1", "self"), ("a", at(1, 1, 12), 100, "s1", "i2", "self"),
        ("a", at(3, 1), 300, "s2", "i1", "other"), ("b", at(3, 2), 50, "s1", "i1", "self"),
        ("b", at(3, 9), 700, "s2", "i2", "other"), ("b", at(4, 1), 20, "s1", "i1", "self"),
        ("c", at(3, 5), 10, "s3", "i3", "other"), ("c", at(3, 5), 0, "s3", "i3", "other"),
    ]
    orders = make_orders([
        {"user_id": u, "pay_time": p, "gmv": g, "sku": s, "influencer_name": i, "channel_type": c}
        for u, p, g, s, i, c in rows])
    smp = orders.where("gmv < 100").withColumn("sample_type", F.col("sku"))
    people = spark.createDataFrame([("a", at(1, 1)), ("c", at(2, 1, year=2022)), ("z", None)],
                                   "user_id string, join_time timestamp_ntz").withColumn(
        "join_ym", F.date_format("join_time", "yyyy-MM"))
    names = spark.createDataFrame([("x", "a"), ("x", "z"), ("y", "a"), ("y", "b")],
                                  "crowd_name string, user_id string")
    return assemble(orders, RULE, samples=smp, members=people, crowds=names)


MARCH = Scope(dates=(dt.date(2024, 3, 1), dt.date(2024, 4, 30)))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(rounded(F.col("x"), 0)).collect()] == [0.0, 2.0, 2.0, -0.0]


def test_delta_is_blank_without_a_previous_value(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 4.0), (5.0, -4.0)], "a double, b double")
    assert [r[0] for r in df.select(delta_percent(F.col("a"), F.col("b"))).collect()] == [None, 25.0, 225.0]


def test_persons_are_exclusive_but_not_in_the_product_table(t):
    # b has new and returning orders of s1 in the range.
    k = kpi.kpi(t.orders, MARCH).first()
    assert (k.buyers, k.new_buyers, k.returning_buyers) == (3, 2, 1)
    assert (k.orders, k.new_orders, k.returning_orders) == (6, 4, 2)
    table = product.product_table(t.orders, MARCH)
    assert rows(table.where("sku = 's1'"), "buyers", "new_buyers", "returning_buyers") == [(1, 1, 1)]
    split = product.product_split(t.orders, MARCH, "buyers")
    assert rows(split.where("sku = 's1'"), "new", "returning", "total") == [(1.0, 0.0, 1.0)]


def test_kpi_of_nothing_is_zero(t):
    k = kpi.kpi(t.orders, Scope(categories=("none",))).first()
    assert (k.orders, k.gmv, k.buyers, k.per_buyer, k.new_share) == (0, 0.0, 0, 0.0, 0.0)


def test_new_and_returning_buyers_add_up_in_every_group(t):
    for df in (channel.channel_summary(t.orders, Scope()), trend.trend_periods(t.orders, Scope())):
        assert df.where("new_buyers + returning_buyers <> buyers").count() == 0


def test_scope_bounds_are_inclusive(t):
    one = Scope(dates=(dt.date(2024, 3, 5), dt.date(2024, 3, 5)))
    assert apply_scope(t.orders, one).count() == 2
    assert apply_scope(t.orders, Scope(min_amount=50, max_amount=300)).count() == 3
    assert apply_scope(t.orders, Scope(sku_keyword="S2")).count() == 2
    assert apply_scope(t.orders, Scope(skus=("s1",), sku_keyword="s2")).count() == 4


def test_year_ago():
    s = Scope(dates=(dt.date(2024, 2, 29), dt.date(2024, 3, 1)))
    assert s.year_ago().dates == (dt.date(2023, 2, 28), dt.date(2023, 3, 1))
    own = (dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    assert Scope(dates=s.dates, previous_dates=own).year_ago().dates == own
    assert Scope().year_ago() is None


def test_overlapping_spans_keep_a_row_in_both(t):
    s = Scope(dates=MARCH.dates, previous_dates=(dt.date(2024, 1, 1), dt.date(2024, 3, 31)))
    spans = apply_two_scopes(t.orders, s).groupBy("span").count()
    assert rows(spans, "span", "count") == [("current", 6), ("previous", 7)]


def test_previous_periods_move_on_by_one_year(make_orders):
    orders = make_orders([{"user_id": "u", "pay_time": at(2, d, year=y)}
                          for y, d in ((2024, 28), (2024, 29), (2025, 28))])
    s = Scope(dates=(dt.date(2025, 2, 1), dt.date(2025, 2, 28)),
              previous_dates=(dt.date(2024, 2, 1), dt.date(2024, 2, 29)))
    out = trend.trend_compare(assemble(orders, RULE).orders, s)
    assert rows(out, "span", "order_date", "new") == [
        ("current", dt.date(2025, 2, 28), 1.0), ("previous", dt.date(2025, 2, 28), 2.0)]


def test_linked_choices(t):
    assert rows(choices(t.orders, "sku", "channel_type", ("self",)), "sku") == [("s1",)]
    everything = [("s1",), ("s2",), ("s3",)]
    assert rows(choices(t.orders, "sku", "channel_type", ()), "sku") == everything
    assert rows(choices(t.orders, "sku", "channel_type", ("nowhere",)), "sku") == everything


def test_pairs_follow_fewer_filters_unless_aligned(t):
    s = Scope(statuses=("closed",), max_amount=1)
    assert scope_pairs(t.pairs, s).count() == 5
    assert scope_pairs(t.pairs, s, align=True).count() == 0


def test_repurchase_counts_same_day_orders_unless_told_otherwise(t):
    rate = repurchase.repurchase_rate(t, Scope()).first()
    assert (rate.entry_users, rate.repeat_users) == (3, 3)
    later = repurchase.repurchase_rate(t, Scope(), min_gap_days=1).first()
    assert (later.entry_users, later.repeat_users) == (3, 2)


def test_destination_users_count_once_per_channel(make_orders):
    # One user goes on to two influencers of the same channel type.
    orders = make_orders([{"user_id": "u", "pay_time": at(1, 1 + k), "influencer_name": i}
                          for k, i in enumerate(("i1", "i2", "i3"))])
    out = repurchase.repurchase_by_channel(assemble(orders, RULE), Scope())
    assert rows(out.where("level = 'channel'"), "to_channel_type", "n_moves", "repeat_users", "rate") == [
        ("self", 2, 1, 100.0)]
    assert rows(out.where("level = 'influencer'"), "to_influencer", "n_moves", "repeat_users") == [
        ("i2", 1, 1), ("i3", 1, 1)]


def test_intervals_of_equal_length_share_one_bin(make_orders):
    orders = make_orders([{"user_id": u, "pay_time": at(1, d)} for u in "ab" for d in (1, 8)])
    out = repurchase.repurchase_intervals(assemble(orders, RULE), Scope())
    assert rows(out, "bin", "n_pairs", "min_days") == [(0, 2, 7)]


def test_flow_totals_are_taken_after_the_threshold(make_orders):
    steps = [("i1", "i2")] * 3 + [("i1", "i3")] * 2 + [("i1", "i4")]
    orders = make_orders([{"user_id": f"u{n}", "pay_time": at(1, 1 + k), "influencer_name": i}
                          for n, pair in enumerate(steps) for k, i in enumerate(pair)])
    out = flow.flow_links(assemble(orders, RULE), Scope(), min_count=2)
    assert rows(out, "target", "n_moves", "source_total", "conversion") == [
        ("2|i2", 3, 5, 60.0), ("2|i3", 2, 5, 40.0)]
    nodes = flow.flow_nodes(assemble(orders, RULE), Scope(), min_count=2)
    assert rows(nodes, "node", "out_flow") == [("1|i1", 5), ("2|i2", 0), ("2|i3", 0)]


@pytest.mark.parametrize("days, label", [
    (0, "0-30"), (30, "0-30"), (31, "30-60"), (60, "30-60"), (365, "180-365"), (366, "365+")])
def test_recency_edges(spark, days, label):
    df = spark.range(1).select(first_match(F.lit(days), rfm.R_BUCKETS, "right").alias("b"))
    assert df.first().b == label


@pytest.mark.parametrize("value, label", [
    ("0", "0-500"), ("500", "0-500"), ("500.01", "500-2000"), ("10000", "5000-10000"),
    ("10000.01", "10000+"), ("-1", "10000+")])
def test_amount_edges(spark, value, label):
    x = F.lit(value).cast("decimal(18,2)")
    assert spark.range(1).select(first_match(x, rfm.M_BUCKETS, "both").alias("b")).first().b == label


@pytest.mark.parametrize("n, label", [(1, "1"), (2, "2"), (5, "3-5"), (6, "6-10"), (11, "10+")])
def test_frequency_edges(spark, n, label):
    assert spark.range(1).select(first_match(F.lit(n), rfm.F_BUCKETS, "both").alias("b")).first().b == label


def test_breakpoints():
    assert rfm.parse_breakpoints("45， 0,15,,15") == [45, 0, 15, 15]
    assert rfm.recency_buckets([45, 0, 15, 15, -3]) == (("0-15", 0, 15), ("15-45", 15, 45), ("45+", 45, None))
    assert rfm.recency_buckets([30]) == (("0-30", 0, 30), ("30+", 30, None))
    with pytest.raises(ValueError):
        rfm.parse_breakpoints("a,b")


def test_date_labels():
    day = dt.date(2024, 3, 31)
    assert rfm.date_label(0, 30, day) == "2024-03-02 ~ 2024-03-31"
    assert rfm.date_label(365, None, day) == "<= 2023-04-01"


def test_rfm_cutoff_is_midnight_unless_days_are_inclusive(make_orders):
    orders = assemble(make_orders([
        {"user_id": "a", "pay_time": at(2, 29, 9), "gmv": 900},
        {"user_id": "b", "pay_time": at(2, 28, 9), "gmv": 900},
        {"user_id": "b", "pay_time": at(3, 31, 9), "gmv": 5}]), RULE).orders
    s = Scope(dates=(dt.date(2024, 3, 1), dt.date(2024, 3, 31)))
    plain = rfm.rfm_users(orders, s, RULE)
    assert rows(plain, "user_id", "r_days", "is_repurchase") == [("b", 0, 0)]
    whole = rfm.rfm_users(orders, s, RULE, inclusive_days=True)
    assert rows(whole, "user_id", "r_days", "is_repurchase") == [("a", 0, 0), ("b", 1, 1)]


def test_rfm_table_keeps_empty_buckets_and_adds_up(t):
    users = rfm.rfm_users(t.orders, MARCH, RULE)
    table = rfm.rfm_table(users, "r", rfm.R_BUCKETS, rfm.cutoff(MARCH)).orderBy("pos").collect()
    assert [r.bucket for r in table] == [b[0] for b in rfm.R_BUCKETS] + ["TTL"]
    assert sum(r.base for r in table[:-1]) == table[-1].base == users.count() == 1
    assert (table[1].bucket, table[1].base, table[1].repurchasers, table[1].amount, table[1].rate) == (
        "30-60", 1, 1, 300.0, 100.0)
    assert rfm.rfm_cross(users).count() == 30


def test_source_trace_uses_the_unfiltered_past(t):
    target = source_trace.Target(skus=("s2",))
    k = source_trace.trace_kpi(t.orders, MARCH, target).first()
    assert (k.target_buyers, k.returning_users, k.with_history) == (2, 1, 1)
    s = Scope(dates=MARCH.dates, channels=("other",))
    assert rows(source_trace.history_by_influencer(t.orders, s, target), "channel_type",
                "influencer_name", "n_users", "share") == [("self", "i1", 1, 100.0), ("self", "i2", 1, 100.0)]


@pytest.mark.parametrize("text, pieces", [
    ("a-b-1,234.50; c-2 ", [("a-b", "1234.50"), ("c", "2.00")]),
    ("plain;-5;a-;a-x", []), ("", []), ("a -7;a-8", [("a", "7.00"), ("a", "8.00")]), ("a-,", [])])
def test_coupon_text(spark, text, pieces):
    df = spark.createDataFrame([(text,)], "platform_discount string")
    got = df.select(F.inline(coupon_array())).collect()
    assert [(r.coupon, str(r.amount)) for r in got] == pieces


def test_subsidy_stays_on_the_order_row(make_orders):
    orders = make_orders([
        {"user_id": "u", "pay_time": at(1, 1), "gmv": 10, "platform_discount": "p-1;q-2;p-3"},
        {"user_id": "u", "pay_time": at(1, 2), "gmv": 20, "sub_order_id": "", "platform_discount": "q-2"}])
    out = with_subsidy(orders, ("p",)).orderBy("pay_time").collect()
    assert [(str(r.subsidy), r.coupon_text, str(r.real_income)) for r in out] == [
        ("4.00", "p(1.00); p(3.00)", "14.00"), ("0.00", "", "20.00")]
    assert coupons(orders).select("order_key").distinct().count() == 2
    totals = discount.subsidy_totals(orders, Scope(), ("p",)).first()
    assert (totals.n_orders, totals.n_subsidised, totals.subsidy, totals.uplift_pct) == (2, 1, 4.0, 13.33)
    stats = discount.coupon_stats(orders, Scope(), ("p",))
    assert rows(stats, "coupon", "n_orders", "amount", "is_selected") == [
        ("p", 1, 4.0, True), ("q", 2, 4.0, False)]
    plan = discount.subsidy_orders(orders, Scope(), ("p",))._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_sample_buyers_need_not_buy_later(t):
    k = samples.sample_kpi(t, MARCH, RULE).first()
    # Samples of b on 2 March and 1 April and of c twice on 5 March.
    assert (k.sample_orders, k.buyers, k.new_buyers) == (4, 2, 2)
    assert (k.repeat_users, k.repeat_orders, k.repeat_gmv) == (2, 5, 780.0)
    after = samples.sample_kpi(t, MARCH, RULE, after_sample=True).first()
    assert (after.repeat_users, after.repeat_orders) == (1, 2)


def test_sample_subtotals_count_users_once(t):
    both = Tables(t.orders, t.pairs, samples=t.samples.withColumn("sample_type", F.lit("one")))
    out = samples.sample_detail(both, MARCH, RULE)
    assert rows(out, "level", "sample_orders", "buyers") == [
        ("sku", 2, 1), ("sku", 2, 1), ("subtotal", 4, 2)]


def test_member_windows(t):
    kinds = members.member_kinds(t.members)
    assert rows(kinds, "user_id", "member_type") == [("a", "new"), ("c", "old"), ("z", "old")]
    k = members.member_kpi(t, MARCH).first()
    assert (k.members, k.new_members, k.buying_members) == (3, 1, 2)
    assert rows(members.member_vs_non(t, MARCH), "is_member", "buyers", "orders") == [(False, 1, 3), (True, 2, 3)]


def test_crowd_users_count_once_together_and_in_each(t):
    assert crowds.crowd_kpi(t, Scope()).first().users == 3
    assert rows(crowds.crowd_compare(t, Scope()), "crowd_name", "users", "buyers", "orders") == [
        ("x", 2, 1, 3), ("y", 2, 2, 6)]


def test_matrix_of_many_values(spark, make_orders):
    """20,000 skus, each bought after the same one: more than a pivot takes columns."""
    n = 20_000
    orders = make_orders([{"user_id": "u", "pay_time": at(1, 1), "sku": "s"}])
    ids = spark.range(n).select(F.col("id").cast("string").alias("user_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    many = ids.join(orders.drop("user_id", "sub_order_id")).select(
        "user_id", F.concat("user_id", F.lit("-"), "k").alias("sub_order_id"),
        F.when(F.col("k") == 1, "hub").otherwise(F.concat(F.lit("s"), "user_id")).alias("sku"),
        (F.col("pay_time") + F.make_dt_interval(F.col("k"))).alias("pay_time"),
        *[c for c in orders.columns if c not in ("user_id", "sub_order_id", "sku", "pay_time")])
    t = assemble(many.select(*orders.columns), LabelRule(50, 1, 365, (), ("done",)))
    out = repurchase.repurchase_cycle_rows(t, Scope(), min_count=1)
    hub = out.where("from_sku = 'hub'").select(F.size("avg_days").alias("n"), F.try_element_at("avg_days", F.lit("s7")).alias("d")).first()
    assert (hub.n, hub.d) == (n, 1.0) and out.count() == n + 1
    wide = repurchase.repurchase_cycle_matrix(t, Scope(), ["hub", "s3", "none"], min_count=1)
    assert [tuple(r) for r in wide.where("from_sku IN ('hub', 's5')").orderBy("from_sku").collect()] == [
        ("hub", None, 1.0, None), ("s5", 1.0, None, None)]


def test_matrix_without_values_has_a_column_for_each(t):
    wide = repurchase.repurchase_cycle_matrix(t, Scope(), min_count=1)
    assert wide.columns[0] == "from_sku" and wide.columns[1:] == sorted(wide.columns[1:])
    assert wide.count() == repurchase.repurchase_cycle_rows(t, Scope(), min_count=1).count()
