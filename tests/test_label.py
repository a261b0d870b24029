"""Labels, ranks and pairs: boundaries, brute force, and users cut into ranges."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from repeatwise.operators import journey as jn
from repeatwise.operators.skew import hot_users
from repeatwise.schema import LabelRule

RULE = LabelRule(500, 1, 365, (), ("done",))
START = dt.datetime(2024, 1, 1, 10, 0, 0)


def _labels(orders, rule=RULE, hot=()):
    rows = jn.label(orders, rule, hot).orderBy("sub_order_id").collect()
    return [r.customer_type for r in rows]


@pytest.mark.parametrize("gap, expected", [
    (dt.timedelta(0), "new"),
    (dt.timedelta(days=1) - dt.timedelta(microseconds=1), "new"),
    (dt.timedelta(days=1), "returning"),
    (dt.timedelta(days=365), "returning"),
    (dt.timedelta(days=366) - dt.timedelta(microseconds=1), "returning"),
    (dt.timedelta(days=366), "new"),
])
@pytest.mark.parametrize("hot", [(), ("u",)])
def test_window_boundaries(make_orders, gap, expected, hot):
    orders = make_orders([
        {"user_id": "u", "pay_time": START, "gmv": 500},
        {"user_id": "u", "pay_time": START + gap, "gmv": 1}])
    assert _labels(orders, hot=hot) == ["new", expected]


def test_what_qualifies(make_orders):
    first = {"user_id": "u", "pay_time": START}
    later = {"user_id": "u", "pay_time": START + dt.timedelta(days=5), "gmv": 1}
    cases = [({"gmv": "499.99"}, "new"), ({"gmv": 500}, "returning"),
             ({"gmv": 900, "order_status": "closed"}, "new"),
             ({"gmv": 900, "channel_type": "other"}, "new")]
    rule = LabelRule(500, 1, 365, ("self",), ("done",))
    for changes, expected in cases:
        assert _labels(make_orders([{**first, **changes}, later]), rule)[1] == expected


def test_no_qualifying_order_leaves_everyone_new(make_orders):
    orders = make_orders([{"user_id": u, "pay_time": START + dt.timedelta(days=d)}
                          for u in "ab" for d in range(3)])
    out = jn.journey(orders, RULE)
    assert {(r.customer_type, r.customer_type_lifetime, r.first_qualify_time)
            for r in out.collect()} == {("new", "new", None)}


def _random_rows(n, users, seed):
    rng = random.Random(seed)
    steps = [0, 1, 59, 86_399, 86_400, 86_401]
    return [{
        "user_id": f"u{rng.randrange(users)}",
        "pay_time": START + dt.timedelta(days=rng.randrange(25), seconds=rng.choice(steps)),
        "gmv": rng.choice([10, 499.99, 500, 700]), "sku": f"s{rng.randrange(3)}",
        "order_status": rng.choice(["done", "done", "closed"]),
    } for _ in range(n)]


def _brute(rows, rule):
    ok = lambda r: r["order_status"] in rule.statuses and r["gmv"] >= rule.min_amount
    return ["returning" if any(
        q["user_id"] == r["user_id"] and ok(q)
        and rule.min_days <= (r["pay_time"] - q["pay_time"]).days <= rule.window
        for q in rows) else "new" for r in rows]


@pytest.mark.parametrize("days, window", [(1, 3), (1, 1), (2, 9), (1, 9999), (5, 2)])
def test_rolling_label_against_brute_force(make_orders, days, window):
    rows = _random_rows(400, 12, days * 100 + window)
    rule = LabelRule(500, days, window, (), ("done",))
    orders = make_orders(rows)
    expected = _brute(rows, rule)
    assert _labels(orders, rule) == expected
    assert _labels(orders, rule, hot=("u0", "u1", "u2")) == expected


def test_unbounded_window_is_the_lifetime_label(make_orders):
    out = jn.journey(make_orders(_random_rows(400, 12, 7)), LabelRule(500, 1, 9999, (), ("done",)))
    assert out.where("customer_type <> customer_type_lifetime").count() == 0


def test_sequence_against_brute_force(make_orders):
    rows = _random_rows(300, 6, 3)
    out = jn.journey(make_orders(rows), RULE)
    by_user = {}
    for i, r in enumerate(rows):
        by_user.setdefault(r["user_id"], []).append((r["pay_time"], f"{i:05d}", r))
    expected = {}
    for items in by_user.values():
        items.sort(key=lambda x: x[:2])
        for k, (t, i, _) in enumerate(items):
            nxt = items[k + 1] if k + 1 < len(items) else None
            expected[i] = (k + 1, nxt and nxt[0], nxt and nxt[2]["sku"])
    got = {r.sub_order_id: (r.purchase_rank, r.next_pay_time, r.next_sku) for r in out.collect()}
    assert got == expected
    p = jn.pairs(out)
    assert p.count() == 300 - len(by_user)
    assert p.where("to_rank <> from_rank + 1 or days_between < 0").count() == 0


def test_users_cut_into_ranges_get_the_same_columns(make_orders):
    # One user owns most rows, many of them at one instant.
    rows = _random_rows(200, 5, 11)
    rows += [{"user_id": "big", "pay_time": START + dt.timedelta(days=i % 4), "gmv": 600 + i,
              "sku": f"s{i}"} for i in range(400)]
    orders = make_orders(rows)
    plain, cut = jn.journey(orders, RULE), jn.journey(orders, RULE, ("big", "u1"))
    columns = sorted(plain.columns)
    assert sorted(cut.columns) == columns
    a, b = plain.select(*columns), cut.select(*columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_users_are_found_by_share(make_orders):
    rows = [{"user_id": "big", "pay_time": START}] * 40
    rows += [{"user_id": f"u{i}", "pay_time": START} for i in range(60)]
    orders = make_orders(rows)
    assert hot_users(orders, share=0.1, floor=5) == ("big",)
    assert hot_users(orders, share=0.1, floor=50) == ()
    assert hot_users(orders) == ()


def test_many_hot_users_are_split_by_join(make_orders, monkeypatch):
    from repeatwise.operators import skew
    monkeypatch.setattr(skew, "LITERALS", 1)
    orders = make_orders([{"user_id": f"u{i % 4}", "pay_time": START} for i in range(20)])
    cold, hot = skew.split(orders, ("u0", "u1"))
    assert (cold.count(), hot.count()) == (10, 10)


def test_label_needs_one_exchange(make_orders):
    plan = jn.journey(make_orders(_random_rows(5, 2, 1)), RULE)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1


def test_relabel_equals_labelling_afresh(make_orders):
    from repeatwise.plans.build import assemble, relabel
    orders = make_orders(_random_rows(200, 5, 21))
    other = LabelRule(10, 2, 5, (), ("done",))
    a = relabel(assemble(orders, RULE), other)
    b = assemble(orders, other)
    for x, y in ((a.orders, b.orders), (a.pairs, b.pairs)):
        columns = sorted(y.columns)
        assert sorted(x.columns) == columns
        assert x.select(*columns).exceptAll(y.select(*columns)).count() == 0


def test_same_day_pairs_count_as_zero_days(make_orders):
    orders = make_orders([{"user_id": "u", "pay_time": START}, {"user_id": "u", "pay_time": START}])
    assert [r.days_between for r in jn.pairs(jn.journey(orders, RULE)).collect()] == [0]
    assert jn.journey(orders, RULE).agg(F.max("purchase_rank")).first()[0] == 2


def test_one_user_with_very_many_orders(spark):
    """The label's frame takes each row in once: minutes if it were summed up again for each."""
    orders = spark.range(200_000).selectExpr(
        "'u' AS user_id", "cast(id AS string) AS sub_order_id", "'s' AS sku", "'i' AS influencer_name",
        "'done' AS order_status", "'none' AS after_sale_status", "cast(id % 7 AS decimal(18,2)) AS gmv",
        "cast(id % 7 AS decimal(18,2)) AS payable_amount", "'c' AS category", "'self' AS channel_type",
        "'' AS platform_discount",
        "timestampadd(HOUR, cast(id AS int), timestamp_ntz'1990-01-01 00:00:00') AS pay_time") \
        .selectExpr("*", "pay_time AS order_submit_time", "cast(pay_time AS date) AS order_date",
                    "date_format(pay_time, 'yyyy-MM') AS order_ym")
    rule = LabelRule(6, 1, 9999, (), ("done",))
    start = time.perf_counter()
    counts = dict(map(tuple, jn.label(orders, rule).groupBy("customer_type").count().collect()))
    assert time.perf_counter() - start < 60
    # The first qualifying order is the seventh; a day later all are returning.
    assert counts == {"new": 6 + 24, "returning": 200_000 - 30}
