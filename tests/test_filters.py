"""Rows of users that no report asks for go before they are combined and shuffled."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.queries import RULE, TARGET, YEAR
from repeatwise.operators.people import distinct_users, maybe_in
from repeatwise.plans import samples, source_trace
from repeatwise.plans.build import assemble
from repeatwise.schema import LabelRule, Scope, Tables
from repeatwise.sources import star

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 20])
def test_every_user_of_the_set_passes(spark, bits):
    everyone = spark.range(3000).select(F.col("id").cast("string").alias("user_id")) \
        .unionByName(spark.createDataFrame([(None,), ("",), ("é",)], "user_id string"))
    chosen = everyone.where("user_id IS NULL OR user_id IN ('', 'é') OR cast(user_id as int) % 50 = 0")
    passed = {r.user_id for r in everyone.where(maybe_in(chosen.unionByName(chosen), bits)).collect()}
    assert {r.user_id for r in chosen.collect()} - {None} <= passed
    # One user in 50: of 2 ** 20 bits hardly any other has one of theirs, of 64 nearly all.
    assert len(passed) <= 70 if bits == 1 << 20 else len(passed) >= 62
    assert everyone.where(maybe_in(chosen.where("false"), bits)).count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Labelled orders and samples on disk, so that plans begin with a scan."""
    path = str(tmp_path_factory.mktemp("stored"))
    orders = star.retail_orders(spark, SF)
    assemble(orders, RULE).orders.write.parquet(f"{path}/orders")
    star.retail_samples(orders).write.parquet(f"{path}/samples")
    return Tables(orders=spark.read.parquet(f"{path}/orders"), samples=spark.read.parquet(f"{path}/samples"))


def reports(t):
    orders = t.orders
    few = samples.SampleScope(dates=YEAR.dates)
    yield "trace_kpi", source_trace.trace_kpi(orders, YEAR, TARGET)
    yield "by_channel", source_trace.history_by_channel(orders, YEAR, TARGET)
    yield "by_influencer", source_trace.history_by_influencer(orders, YEAR, TARGET)
    yield "by_category", source_trace.history_by_category(orders, YEAR, TARGET, ("self",))
    yield "of_source", source_trace.history_of_source(orders, YEAR, TARGET, ("self",))
    yield "buyers", samples.sample_buyers(t, YEAR, RULE, few)
    yield "after", samples.sample_buyers(t, YEAR, RULE, few, after_sample=True)
    yield "products", samples.sample_products(t, YEAR, few)
    yield "detail", samples.sample_detail(t, YEAR, RULE, few)


def nodes(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_the_filter_lies_below_the_first_exchange(stored):
    for name, df in reports(stored):
        filters = [n for n in nodes(df._jdf.queryExecution().optimizedPlan())
                   if n.nodeName() == "Filter" and "getbit" in n.condition().toString()]
        assert filters, name
        for f in filters:  # nothing that combines or moves rows lies between it and the scan
            assert {n.getClass().getSimpleName() for n in nodes(f)} <= {"Filter", "Project", "LogicalRelation"}, name
            assert "xxhash64(user_id" in f.condition().toString()


def test_rows_are_those_without_the_filter(spark, stored, monkeypatch):
    found = {name: sorted(map(str, df.collect())) for name, df in reports(stored)}
    for module in (samples, source_trace):
        monkeypatch.setattr(module, "maybe_in", lambda users: F.lit(True))
    plain = {name: sorted(map(str, df.collect())) for name, df in reports(stored)}
    assert found == plain and sum(map(len, found.values())) > 20
    # A table of a single word lets other users pass; the joins above are exact.
    for module in (samples, source_trace):
        monkeypatch.setattr(module, "maybe_in", lambda users: maybe_in(users, 64))
    assert {name: sorted(map(str, df.collect())) for name, df in reports(stored)} == plain


def test_hot_and_missing_users_pass_the_filter_as_others(spark, make_orders):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    orders = make_orders([{"user_id": u, "pay_time": at(i % 300), "gmv": 900} for u in ("hot", "b") for i in range(200)])
    smp = orders.where("user_id = 'hot'").withColumn("sample_type", F.lit("x"))
    rule = LabelRule(500, 1, 365, (), ("done",))
    scope = Scope(dates=(dt.date(2024, 3, 1), dt.date(2024, 12, 31)))
    for hot in ((), ("hot",)):
        t = assemble(orders, rule, hot=hot, samples=smp)
        k = samples.sample_kpi(t, scope, rule, after_sample=True).first()
        assert (k.buyers, k.repeat_users, k.repeat_orders) == (1, 1, 140)
    assert distinct_users(orders.where(maybe_in(smp))).count() == 1
