"""Cleaning of untidy text."""

import datetime as dt

import pytest

from repeatwise.functions.columns import parse_money, parse_time
from repeatwise.operators import clean
from repeatwise.operators.clean import clean_crowds, clean_members
from repeatwise.schema import ORDER_COLUMNS, SAMPLE_COLUMNS, SOURCE_COLUMNS


def _raw(spark, columns, rows, **defaults):
    names = [*columns, "_file", "_pos"]
    data = [tuple(({"_file": "f", "_pos": f"{i:04d}", **defaults, **r}).get(n) for n in names)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))


DEFAULTS = {"user_id": "u", "sub_order_id": "1", "sku": "s", "influencer_name": "i",
            "order_status": "ok", "after_sale_status": "x", "payable_amount": "1",
            "pay_time": "2024-01-02 03:04:05", "order_submit_time": "2024-01-01 00:00:00",
            "category": "c", "channel_type": "ch", "platform_discount": "a-1"}


def _orders(spark, rows, **kw):
    rows = [{"sub_order_id": str(i), **r} for i, r in enumerate(rows)]
    return clean.clean_orders(_raw(spark, ORDER_COLUMNS, rows, **DEFAULTS), **kw).orderBy(
        "sub_order_id").collect()


@pytest.mark.parametrize("text, value", [
    ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024/1/2 3:04", dt.datetime(2024, 1, 2, 3, 4)),
    (" 2024-1-2 ", dt.datetime(2024, 1, 2)),
    ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-02-30", None), ("soon", None), ("2024", None), ("", None), (None, None)])
def test_times(spark, text, value):
    out = _orders(spark, [{"pay_time": text}, {}])
    assert [r.pay_time for r in out if r.sub_order_id == "0"] == ([value] if value else [])


@pytest.mark.parametrize("text, value", [
    ("12.5", "12.50"), (" 7 ", "7.00"), ("1.5e3", "1500.00"), (".5", "0.50"), ("-3", "-3.00"),
    ("12d", "0.00"), ("1,000", "0.00"), ("nan", "0.00"), ("", "0.00"), (None, "0.00")])
def test_amounts(spark, text, value):
    row = _orders(spark, [{"payable_amount": text}])[0]
    assert str(row.gmv) == str(row.payable_amount) == value


@pytest.mark.parametrize("column, tokens, default, kept", [
    ("sku", [None, "nan", "", "  "], "unknown", "-"),
    ("order_status", [None, "nan", ""], "unknown", "None"),
    ("after_sale_status", [None, "nan", "", "-", "None"], "none", "refund"),
    ("influencer_name", [None, "nan", ""], "shelf", "-"),
    ("category", [None, "nan", ""], "unclassified", "None"),
    ("channel_type", [None, "nan", ""], "unknown", "-"),
    ("platform_discount", [None, "nan", "-", "None", ""], "", "x")])
def test_missing_tokens(spark, column, tokens, default, kept):
    out = _orders(spark, [{column: t} for t in tokens] + [{column: f" {kept} "}])
    assert [getattr(r, column) for r in out] == [default] * len(tokens) + [kept]


def test_absent_columns_get_defaults(spark):
    raw = _raw(spark, ("user_id", "order_submit_time"), [{"user_id": "u", "order_submit_time": "2024-05-06"}])
    row = clean.clean_orders(raw).first()
    assert (row.sku, row.influencer_name, row.after_sale_status, row.category) == (
        "unknown", "shelf", "none", "unclassified")
    assert (row.pay_time, row.order_ym, float(row.gmv)) == (dt.datetime(2024, 5, 6), "2024-05", 0.0)


def test_rows_without_time_or_user_go_and_blank_users_stay(spark):
    out = _orders(spark, [{"user_id": None}, {"user_id": " "}, {"user_id": " u "}, {"pay_time": "x"}])
    assert [r.user_id for r in out] == ["", "u"]


def test_submit_time_replaces_pay_time_only_if_there_is_none_at_all(spark):
    some = _orders(spark, [{"pay_time": None}, {}])
    assert [r.sub_order_id for r in some] == ["1"]
    none = _orders(spark, [{"pay_time": None}, {"pay_time": "bad"}])
    assert [r.pay_time for r in none] == [dt.datetime(2024, 1, 1)] * 2
    rowwise = _orders(spark, [{"pay_time": None}, {}], rowwise_time=True)
    assert [r.pay_time.day for r in rowwise] == [1, 2]


def test_first_copy_wins_and_missing_ids_fall_back(spark):
    rows = [{"sub_order_id": "a", "sku": "first"}, {"sub_order_id": " a ", "sku": "second"},
            {"sub_order_id": "nan", "sku": "x"}, {"sub_order_id": None, "sku": "x"},
            {"sub_order_id": "", "sku": "y"}]
    raw = _raw(spark, ORDER_COLUMNS, rows, **DEFAULTS)
    out = {(r.sub_order_id, r.sku) for r in clean.clean_orders(raw).collect()}
    assert out == {("a", "first"), ("", "x"), ("", "y")}


def test_copies_are_combined_before_the_shuffle(spark):
    df = clean.keep_first(_raw(spark, ("user_id",), [{"user_id": "u"}]),
                          {"_k": clean.F.col("user_id")}, ["_file", "_pos"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_only_wanted_columns_are_shuffled(spark):
    raw = _raw(spark, ORDER_COLUMNS, [{"sub_order_id": "a"}, {"sub_order_id": "a", "sku": "second"}], **DEFAULTS)
    whole, days = clean.clean_orders(raw), clean.clean_orders(raw, columns=("order_date", "order_ym"))
    assert [tuple(r) for r in days.collect()] == [(r.order_date, r.order_ym) for r in whole.collect()]
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert "platform_discount" not in plan[:plan.index("LogicalRDD")].split("min_by(", 1)[1].split(")", 1)[0]
    carried = whole._jdf.queryExecution().optimizedPlan().toString().split("min_by(struct(", 1)[1].split(")", 1)[0]
    assert "gmv" in carried and "payable_amount" not in carried and "order_ym" not in carried


def test_samples_fill_times_row_by_row(spark):
    rows = [{"sub_order_id": "1", "pay_time": None}, {"sub_order_id": "2"},
            {"sub_order_id": None, "sku": "a"}, {"sub_order_id": "nan", "sku": "b", "sample_type": "-"}]
    defaults = {**{c: "v" for c in SAMPLE_COLUMNS}, "pay_time": "2024-01-02", "payable_amount": "9",
                "order_submit_time": "2024-01-01"}
    out = clean.clean_samples(_raw(spark, SAMPLE_COLUMNS, rows, **defaults)).collect()
    assert sorted((r.sub_order_id, r.sku, r.sample_type, r.pay_time.day) for r in out) == [
        ("", "a", "v", 2), ("", "b", "unknown", 2), ("1", "v", "v", 1), ("2", "v", "v", 2)]


def test_members_keep_the_earliest_join(spark):
    rows = [("u", "2024-03-01"), (" u", "2024-02-01"), ("v", "?"), ("nan", "2024-01-01"), (None, None)]
    raw = spark.createDataFrame(rows, "user_id string, join_time string")
    out = {r.user_id: (r.join_time, r.join_ym) for r in clean.clean_members(raw).collect()}
    assert out == {"u": (dt.datetime(2024, 2, 1), "2024-02"), "v": (None, None)}


def test_crowds_are_distinct(spark):
    raw = spark.createDataFrame(
        [("a", "u"), ("a ", " u"), (None, "u"), ("nan", "u"), ("a", "None"), ("b", "")],
        "crowd_name string, user_id string")
    out = {tuple(r) for r in clean.clean_crowds(raw).collect()}
    assert out == {("a", "u"), ("unnamed", "u")}


def test_only_allowed_columns_survive(spark):
    headers = [SOURCE_COLUMNS["user_id"], "phone", SOURCE_COLUMNS["sku"]]
    raw = spark.createDataFrame([("u", "1", "s")], ", ".join(f"`{h}` string" for h in headers))
    assert clean.rename_and_keep(raw, ORDER_COLUMNS).columns == ["user_id", "sku"]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024/1/2 3:04", "2024-01-02 03:04:00"),
    ("20240102", "2024-01-02 00:00:00"), ("20240102 03:04:05", "2024-01-02 03:04:05"),
    ("2024.1.2", "2024-01-02 00:00:00"), ("2024-01-02 3:04:05 PM", "2024-01-02 15:04:05"),
    ("2024-01-02 12:04:05 am", "2024-01-02 00:04:05"), ("2024-01-02 12:30 PM", "2024-01-02 12:30:00"),
    ("2024-01-02   03:04:05", "2024-01-02 03:04:05"), ("\t2024-01-02　", "2024-01-02 00:00:00"),
    ("2024-01-02 15:04 PM", None), ("2024-01-02 03:04:05.250", "2024-01-02 03:04:05.25"),
    ("2024", None), ("20241302", None), ("bad", None), ("", None), (None, None),
])
def test_time_formats(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_time("t").cast("string")).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    (" 7\t", "7.00"), (" 12.5　", "12.50"), ("1e3", "1000.00"), ("12.345", "12.35"),
    ("9999999999999999.99", "9999999999999999.99"), ("12d", "0.00"), ("", "0.00"), (None, "0.00"),
])
def test_amounts(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert str(df.select(parse_money("a")).first()[0]) == expected


@pytest.mark.parametrize("text", ["1e17", "123456789012345678"])
def test_amounts_out_of_range_are_an_error(spark, text):
    with pytest.raises(Exception, match="amount out of range"):
        spark.createDataFrame([(text,)], "a string").select(parse_money("a")).collect()


def test_white_space_of_all_kinds_is_stripped(spark):
    df = spark.createDataFrame([("\t7　",), ("7 \n",), ("7",), ("  ",)], "user_id string")
    assert [r.user_id for r in clean_members(df).collect()] == ["7"]


def test_members_and_crowds_without_users_are_empty(spark):
    df = spark.createDataFrame([("x", "2024-01-01")], "crowd_name string, join_time string")
    with pytest.warns(UserWarning, match="no user column"):
        assert clean_members(df).count() == 0
    with pytest.warns(UserWarning, match="no user column"):
        assert clean_crowds(df).count() == 0


def test_times_are_parsed_once(spark):
    """A time is one pattern wherever it is used, and generated code stays small enough to be compiled."""
    raw = _raw(spark, ORDER_COLUMNS, [{"sub_order_id": "1"}, {"sub_order_id": "2", "pay_time": "2024/1/2 3:04"}], **DEFAULTS)
    for out in (clean.clean_orders(raw), clean.clean_orders(raw, rowwise_time=True)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("regexp_replace") <= 8
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert clean.clean_orders(raw).count() == 2 and len(clean.clean_orders(raw).collect()) == 2
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("text, expected", [
    ("2024/1/2\t3:04 pm", "2024-01-02 15:04:00"), ("2024/1/2T3:04:05.5", "2024-01-02 03:04:05.5"),
    ("2024.1.2  3:04:05  +08:00", "2024-01-02 03:04:05"), ("20240102 3:04pm", "2024-01-02 15:04:00"),
    ("2024/1/2 PM", None), ("2024/1/2 3|04", None), ("\x1f2024/1/2\x1f3:04", "2024-01-02 03:04:00"),
    ("2024/1/2x", None), ("2024/1/2 3:04 junk", None), ("2024/1/2 0:30 AM", None), ("2024-1/2", "2024-01-02 00:00:00")])
def test_unusual_times(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_time("t").cast("string")).first()[0] == expected


def test_rejected_rows_tell_why(spark):
    rows = [{"user_id": None}, {"pay_time": "x"}, {"pay_time": "x", "user_id": None}, {"payable_amount": "1e17"}, {}]
    raw = _raw(spark, ORDER_COLUMNS, [{"sub_order_id": str(i), **r} for i, r in enumerate(rows)], **DEFAULTS)
    out = clean.rejected(raw, ORDER_COLUMNS).orderBy("sub_order_id").collect()
    assert [(r.sub_order_id, r.pay_time, r.payable_amount, r.reason) for r in out] == [
        ("0", DEFAULTS["pay_time"], "1", "no user"), ("1", "x", "1", "no readable time"),
        ("2", "x", "1", "no readable time"), ("3", DEFAULTS["pay_time"], "1e17", "amount out of range")]
    assert [r.sub_order_id for r in clean.clean_orders(raw, strict=False).collect()] == ["4"]
    assert clean.rejected(raw.drop("payable_amount", "order_submit_time"), ORDER_COLUMNS).count() == 3
