"""Landing zone, stored tables, catalogue and export."""

import datetime as dt
import json
import os
import pathlib
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from repeatwise.plans import build as build_module
from repeatwise.plans.build import build, build_report
from repeatwise.operators.scope import choices, linked_choices, scope_pairs
from repeatwise.plans import channel, members
from repeatwise.schema import FILE_KEYWORDS, LabelRule, SOURCE_COLUMNS, Scope, SourceMissing
from repeatwise.sources import landing, store

H = SOURCE_COLUMNS


def _csv(path, header, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]), encoding="utf-8")


def test_files_are_stacked_by_name_as_text(spark, tmp_path):
    _csv(tmp_path / "a orders.csv", ["x", "y"], ["01", "2"], ["3", "4"])
    _csv(tmp_path / "b orders.csv", ["y", "z"], ["5", "6"])
    _csv(tmp_path / "~$a orders.csv", ["x", "y"], ["lock", "lock"])
    _csv(tmp_path / "other.csv", ["x"], ["9"])
    (tmp_path / "notes.txt").write_text("x\n1")
    raw = landing.load_landing(spark, str(tmp_path), "orders")
    assert {f.dataType.typeName() for f in raw.select("x", "y", "z").schema} == {"string"}
    rows = raw.orderBy("_file", "_pos").select("x", "y", "z").collect()
    assert [tuple(r) for r in rows] == [("01", "2", None), ("3", "4", None), (None, "5", "6")]


def test_a_folder_is_read_as_one_unit(spark, tmp_path):
    for i in range(3):
        _csv(tmp_path / "2024 orders" / f"part-{i}.csv", ["x", "y"], [str(i), "0"])
    units = landing.landing_units(spark, str(tmp_path), "orders")
    assert units == [(f"{tmp_path}/2024 orders", "csv")]
    assert landing.load_landing(spark, str(tmp_path), "orders").count() == 3


def test_headers_inside_a_folder_may_differ(spark, tmp_path):
    _csv(tmp_path / "orders" / "part-0.csv", ["x", "y"], ["1", "2"])
    _csv(tmp_path / "orders" / "deep" / "part-1.csv", ["y", "x"], ["3", "4"])
    raw = landing.load_landing(spark, str(tmp_path), "orders")
    assert sorted(map(tuple, raw.select("x", "y").collect())) == [("1", "2"), ("4", "3")]


def test_files_that_cannot_be_read_are_an_error(spark, tmp_path):
    _csv(tmp_path / "orders_a.csv", ["x"], ["1"])
    (tmp_path / "orders_b.xlsx").write_bytes(b"PK")
    with pytest.raises(landing.UnreadableSource, match="orders_b.xlsx"):
        landing.load_landing(spark, str(tmp_path), "orders")


def test_awkward_deliveries(spark, tmp_path):
    import gzip

    (tmp_path / "orders_a.csv").write_text('\ufeffx,y\n1,"two\nlines ""quoted"""\n', encoding="utf-8")
    with gzip.open(tmp_path / "orders_b.csv.gz", "wt") as f:
        f.write("y,x\n3,2\n")
    _csv(tmp_path / "orders_e[1] {x}.csv", ["x", "y"], ["4", "5"])
    (tmp_path / "orders_empty.csv").write_text("")
    spark.createDataFrame([(6, "7")], "x int, y string").write.parquet(str(tmp_path / "orders_f" / "sub"))
    _csv(tmp_path / "orders_f" / "g.csv", ["x", "y"], ["8", "9"])
    spark.createDataFrame([("10", "11")], "x string, y string").write.parquet(str(tmp_path / "orders_h"))
    near = os.path.relpath(tmp_path, spark._jvm.java.lang.System.getProperty("user.dir"))
    for path in (str(tmp_path), near, f"./{near}", f"{tmp_path}/"):
        raw = landing.load_landing(spark, path, "orders")
        assert sorted(map(tuple, raw.select("x", "y").collect())) == sorted([
            ("1", 'two\nlines "quoted"'), ("2", "3"), ("4", "5"), ("6", "7"), ("8", "9"), ("10", "11")])


@pytest.mark.parametrize("row", ["1,2,3", "1"])
def test_malformed_rows_are_an_error(spark, tmp_path, row):
    (tmp_path / "orders.csv").write_text(f"x,y\n1,2\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        landing.load_landing(spark, str(tmp_path), "orders").select("x").collect()


def test_missing_sources(spark, tmp_path):
    _csv(tmp_path / "x.csv", ["x"], ["1"])
    with pytest.raises(SourceMissing):
        landing.load_landing(spark, str(tmp_path), "orders")
    assert landing.load_landing(spark, str(tmp_path), "orders", required=False) is None


ORDER_HEADER = [H["user_id"], H["sub_order_id"], H["sku"], H["order_status"], H["payable_amount"],
                H["pay_time"], H["influencer_name"], H["channel_type"], "phone"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    zone, out = tmp_path_factory.mktemp("zone"), str(tmp_path_factory.mktemp("out"))
    _csv(zone / f"一月{FILE_KEYWORDS['orders']}.csv", ORDER_HEADER,
         ["u1", "1", "s1", "已完成", "600", "2024-01-01 10:00:00", "i1", "自营", "secret"],
         ["u1", "1", "s9", "已完成", "600", "2024-01-01 10:00:00", "i1", "自营", "secret"],
         ["u1", "2", "s2", "已完成", "20", "2024/2/3 9:00", "", "达人", "secret"],
         ["u2", "3", "s1", "已关闭", "900", "2024-02-05", "i1", "自营", "secret"])
    _csv(zone / f"{FILE_KEYWORDS['members']}.csv", [H["user_id"], H["join_time"]], ["u1", "2024-01-05"])
    return build(spark, str(zone), out, LabelRule(), with_pairs=True), out


def test_build_from_source_headers(built):
    t, out = built
    assert not os.path.exists(f"{out}/_cleaned_orders")
    rows = t.orders.orderBy("sub_order_id").collect()
    assert [(r.sub_order_id, r.sku, r.customer_type, r.purchase_rank) for r in rows] == [
        ("1", "s1", "new", 1), ("2", "s2", "returning", 2), ("3", "s1", "new", 1)]
    assert rows[1].influencer_name == "shelf"
    assert rows[1].first_qualify_sku == "s1"
    assert "phone" not in t.orders.columns
    assert [r.days_between for r in t.pairs.collect()] == [32]
    assert t.members.first().join_ym == "2024-01"


def test_build_counts_what_it_drops(spark, tmp_path):
    header = [*ORDER_HEADER[:8]]
    good = ["u1", "1", "s1", "ok", "600", "2024-01-01", "i1", "c"]
    _csv(tmp_path / "in" / f"{FILE_KEYWORDS['orders']}.csv", header, good, good, ["u1", "2", "s", "ok", "1e20", "2024-01-01", "i", "c"],
         ["", "3", "s", "ok", "1", "2024-01-01", "i", "c"], ["u2", "4", "s", "ok", "1", "soon", "i", "c"])
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="amount out of range"):
        build(spark, str(tmp_path / "in"), out)
    t = build(spark, str(tmp_path / "in"), out, strict=False, with_rejected=True)
    assert t.orders.count() == 1 + t.orders.where("user_id = ''").count()
    counts = {(r.source, r.measure): r.n_rows for r in build_report(spark, out).collect()}
    assert counts == {("orders", "rows read"): 5, ("orders", "no readable time"): 1, ("orders", "no user"): 1,
                      ("orders", "amount out of range"): 1, ("orders", "copies"): 1, ("orders", "kept"): 1}
    found = spark.read.parquet(f"{out}/rejected/orders").collect()
    assert sorted((r.sub_order_id, r.reason) for r in found) == [
        ("2", "amount out of range"), ("3", "no user"), ("4", "no readable time")]


def test_absent_tables_are_none_and_their_reports_say_so(built):
    t, _ = built
    assert t.samples is None and t.crowds is None
    with pytest.raises(SourceMissing, match="crowds"):
        t.need("crowds")
    assert members.member_kpi(t, Scope()).first().buying_members == 1


def test_stored_pairs_equal_those_read_off_the_orders(spark, built):
    t, out = built
    stored = store.load_table(spark, out, "pairs")
    assert stored.columns and stored.exceptAll(t.pairs.select(*stored.columns)).count() == 0
    assert stored.count() == t.pairs.count()


def test_date_scope_prunes_months(spark, built):
    t, _ = built
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    scope = Scope(dates=(dt.date(2024, 2, 1), dt.date(2024, 2, 29)))
    summary = channel.channel_summary(t.orders, scope)
    assert {r.channel_type: r.orders for r in summary.collect()} == {"自营": 1, "达人": 1}
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_ym" in plan
    assert "GreaterThanOrEqual(gmv,0.00)" in plan
    pairs = scope_pairs(t.pairs, scope)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_ym" in pairs


def test_months_are_laid_out_without_a_shuffle_and_in_few_files(spark, built, tmp_path, monkeypatch):
    t, _ = built
    hints, frame, out = [], type(t.orders), str(tmp_path / "again")
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, *how: hints.append(how) or hint(self, *how))
    spread = t.orders.where("order_ym is not null").repartition(3)
    store.save(replace(t, orders=spread.withColumn("order_ym", F.expr("if(sku = 's2', null, order_ym)"))), out)
    assert ("rebalance", "order_ym") not in hints
    months = sorted(f.name for f in (tmp_path / "again" / "orders").iterdir() if f.is_dir())
    assert "order_ym=__HIVE_DEFAULT_PARTITION__" in months and len(months) > 1
    assert all(len(list((tmp_path / "again" / "orders" / m).glob("*.parquet"))) == 1 for m in months)
    assert not list((tmp_path / "again").glob("_*"))
    back, columns = store.load(spark, out).orders, [c for c in t.orders.columns if c != "order_ym"]
    assert back.select(columns).exceptAll(t.orders.select(columns)).count() == 0 and back.count() == t.orders.count()
    store.save(replace(t, orders=t.orders.limit(0)), out)
    assert store.load(spark, out).orders.count() == 0


def test_a_build_deals_orders_by_user_before_it_adds_columns(spark, tmp_path, monkeypatch):
    _csv(tmp_path / "in" / f"{FILE_KEYWORDS['orders']}.csv", ORDER_HEADER[:8],
         ["u1", "1", "s1", "ok", "600", "2024-01-01", "i1", "c"], ["u1", "2", "s1", "ok", "7", "2024-02-01", "i1", "c"])
    plans, whole = [], build_module.assemble

    def spy(orders, *rest, **tables):
        plans.append(orders._jdf.queryExecution().optimizedPlan().toString())
        return whole(orders, *rest, **tables)

    monkeypatch.setattr(build_module, "assemble", spy)
    t = build(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    made, dealt = plans[0].index("order_ym"), plans[0].index("RepartitionByExpression [user_id")
    assert made < dealt and "order_ym" not in plans[0][dealt:]
    assert {(r.sub_order_id, r.order_ym, str(r.order_date), str(r.payable_amount)) for r in t.orders.collect()} == {
        ("1", "2024-01", "2024-01-01", "600.00"), ("2", "2024-02", "2024-02-01", "7.00")}


def test_catalogue_and_extent(built):
    t, out = built
    rows = {tuple(r) for r in store.catalogue(t.orders).collect()}
    assert ("sku", None, "s2") in rows
    assert ("channel_type/influencer_name", "达人", "shelf") in rows
    assert ("category/sku", "unclassified", "s1") in rows
    text = next(pathlib.Path(out, "extent").glob("part-*.json")).read_text()
    assert json.loads(text) == {"date_min": "2024-01-01", "date_max": "2024-02-05", "gmv_max": 900.0,
                                "total_rows": 3, "total_users": 2}


def test_quotes_commas_blanks_and_byte_order_mark_survive(spark, tmp_path):
    texts = ['say "hi", twice', " padded ", "back\\slash", '"']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    store.export_csv(df.coalesce(1), str(tmp_path / "orders"))
    raw = landing.load_landing(spark, str(tmp_path), "orders")
    assert [r.x for r in raw.orderBy("i").collect()] == texts
    (tmp_path / "marked.csv").write_text("x,y\n1,2", encoding="utf-8-sig")
    assert landing.load_landing(spark, str(tmp_path), "marked").select("x", "y").first() == ("1", "2")


def test_csv_export_has_a_header(spark, built, tmp_path):
    t, _ = built
    store.export_csv(channel.channel_summary(t.orders, Scope()), str(tmp_path / "x"))
    back = spark.read.csv(str(tmp_path / "x"), header=True)
    assert back.columns[:2] == ["channel_type", "orders"] and back.count() == 2


@pytest.mark.parametrize("of, to", [("influencer_name", "channel_type"), ("sku", "category")])
def test_choices_come_from_the_stored_catalogue(spark, built, of, to):
    t, out = built
    catalogue = store.load_catalogue(spark, out)
    for selected in ((), ("自营",), ("达人", "自营"), ("unclassified",), ("nothing",)):
        found = linked_choices(catalogue, of, to, selected)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, choices(t.orders, of, to, selected).collect()))
        files = [f for f in found.inputFiles() if "/catalogue/" not in f]
        assert not files
