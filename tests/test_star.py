"""Tables derived from the star schema, on rows of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import queries
from repeatwise.operators.journey import journey
from repeatwise.operators.skew import hot_users
from repeatwise.schema import LabelRule
from repeatwise.sources import star, store

DAY = dt.datetime(2000, 1, 1)


def _write(spark, folder, parts=1):
    lines = [(o, n, 10.0 * o, 0.0, "N", DAY, 1, 1) for o in (1, 2, 3) for n in (1, 2)]
    # Of the copies of a line item the one with the smallest part is the first.
    lines += [(1, 1, 99.0, 0.0, "A", DAY, 2, 1), (1, 1, 98.0, 0.0, "R", DAY, 1, 1)]
    tables = {
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
        "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, "s", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(1, "b", "t")] * parts + [(2, "c", "t")], "p_partkey long, p_brand string, p_type string"),
        "orders": ([(1, 7, "F", DAY), (2, 7, "F", DAY), (3, 8, "O", DAY)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, "
                            "l_returnflag string, l_shipdate timestamp_ntz, l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_first_of_repeated_line_items(spark, tmp_path):
    orders = star.retail_orders(spark, _write(spark, tmp_path / "t"))
    got = {(r.sub_order_id, r.sku, float(r.gmv)) for r in orders.collect()}
    assert got == {("1-1", "b", 10.0), ("1-2", "b", 10.0), ("2-1", "b", 20.0), ("2-2", "b", 20.0),
                   ("3-1", "b", 30.0), ("3-2", "b", 30.0)}
    assert orders.count() == 6


@pytest.mark.parametrize("raw", [False, True])
def test_line_items_are_not_shuffled_by_supplier_and_once_by_order(spark, tmp_path, raw):
    folder = _write(spark, tmp_path / "t")
    plan = (star.raw_orders if raw else star.retail_orders)(spark, folder)._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    assert "Exchange hashpartitioning(l_suppkey" not in plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") <= 1


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_of_a_user_are_bounded(spark, tmp_path, parts):
    folder = _write(spark, tmp_path / "t", parts)
    most = star.most_rows_of_user(spark, folder)
    rows = star.retail_orders(spark, folder).groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert rows <= most == 6 * parts
    assert hot_users(star.retail_orders(spark, folder), 0.0, most) == ()


def test_catalogue_shuffles_entries_only(spark, tmp_path):
    orders = star.retail_orders(spark, _write(spark, tmp_path / "t"))
    found = store.catalogue(orders)
    assert {(r.kind, r.parent, r.value) for r in found.collect()} >= {
        ("sku", None, "b"), ("category/sku", "t", "b"), ("channel_type", None, "self")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # line items, entries


def _plan(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan =="):]


def test_deliveries_hold_all_rows_and_only_those_without_an_id_are_sorted_as_a_whole(spark, tmp_path):
    folder = _write(spark, tmp_path / "t")
    more = [(13, n, 10.0, 0.0, "N", DAY, 1, 1) for n in (1, 2, 3, 3, None)] + [(1, 1, 97.0, 0.0, "R", DAY, 1, 1)]
    spark.createDataFrame(more, spark.read.parquet(f"{folder}/lineitem.parquet").schema) \
        .write.mode("append").parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(13, 7, "F", DAY)], spark.read.parquet(f"{folder}/orders.parquet").schema) \
        .write.mode("append").parquet(f"{folder}/orders.parquet")
    named, others = star.raw_deliveries(spark, folder)
    texts = lambda df: sorted(map(str, df.collect()))
    assert texts(named.unionByName(others)) == texts(star.raw_orders(spark, folder))
    assert all(r.sub_order_id in (None, "", "nan", "None") for r in others.collect())
    assert "rangepartitioning" not in _plan(named) and "rangepartitioning" in _plan(others)
    rows = named.withColumn("task", F.spark_partition_id()).collect()
    copies = [(r.task, r._pos) for r in rows if r.sub_order_id.strip() == "1-1"]
    assert len(copies) == 4 and copies == sorted(copies) and len({task for task, _ in copies}) == 1


def test_orders_dealt_by_user_need_no_further_shuffle_for_the_journey(spark, tmp_path):
    folder = _write(spark, tmp_path / "t")
    plain, dealt = (journey(star.retail_orders(spark, folder, by_user=b), LabelRule(statuses=("completed",))) for b in (False, True))
    assert "Exchange hashpartitioning(user_id" in _plan(plain) and "Exchange hashpartitioning(user_id" not in _plan(dealt)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))


def test_plans_in_ranges_read_line_items_once(spark, tmp_path):
    folder = _write(spark, tmp_path / "t")
    t = queries.tables_in_ranges(spark, folder)
    assert "l_orderkey" in _plan(star.retail_orders(spark, folder)) and "l_orderkey" not in _plan(t.orders)
    columns = star.retail_orders(spark, folder).columns
    assert sorted(map(str, t.orders.select(*columns).collect())) == sorted(map(str, star.retail_orders(spark, folder).collect()))
