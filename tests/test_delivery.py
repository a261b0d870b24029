"""Two deliveries, one after the other, give the tables of a single build of both."""

import random

import pytest

from repeatwise.plans import delivery
from repeatwise.plans.build import build, build_report
from repeatwise.plans.delivery import add_delivery
from repeatwise.schema import FILE_KEYWORDS, LabelRule, SOURCE_COLUMNS
from repeatwise.sources import store

H = SOURCE_COLUMNS
ORDERS = [H[c] for c in ("user_id", "sub_order_id", "sku", "order_status", "payable_amount", "pay_time",
                         "influencer_name", "channel_type", "category")]
RULE = LabelRule(100, 2, 60, (), ("ok",))


def _csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(r) for r in rows]]), encoding="utf-8")


def _orders(r, n, months, first):
    rows = []
    for i in range(n):
        number = "" if r.random() < .1 else str(first + i)
        rows.append([f"u{r.randint(0, 40)}", number, f"s{r.randint(0, 5)}", r.choice(["ok", "no"]),
                     r.choice(["50", "150", "x", "1e20"]), r.choice(["bad", ""]) if r.random() < .1 else
                     f"2024-{r.choice(months):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:00:00",
                     r.choice(["", "i1"]), "c", r.choice(["a", "b"])])
    return rows


def _zone(folder, orders, day):
    """`day` sorts files by delivery."""
    _csv(folder / f"{day}{FILE_KEYWORDS['orders']}.csv", ORDERS, orders)
    _csv(folder / f"{day}{FILE_KEYWORDS['samples']}.csv", [*ORDERS[:6], H["sample_type"]],
         [[*o[:6], "t"] for o in orders[::3]])
    _csv(folder / f"{day}{FILE_KEYWORDS['members']}.csv", [H["user_id"], H["join_time"]],
         [[o[0], o[5]] for o in orders[::2]])
    _csv(folder / f"{day}{FILE_KEYWORDS['crowds']}.csv", [H["crowd_name"], H["user_id"]],
         [["big" if len(o[0]) > 2 else day, o[0]] for o in orders[::4]])


@pytest.fixture(scope="module")
def zones(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("zones"), random.Random(4)
    first = _orders(r, 250, [1, 2, 3, 4, 5], 0)
    # Late orders of earlier months, copies of delivered ones with other amounts, new users.
    second = _orders(r, 40, [3, 5, 6], 1000) + [[*o[:4], "999", *o[5:]] for o in first[:60]]
    second += [["new1", "5000", "s1", "ok", "150", "2024-06-01", "i1", "c", "a"]] * 2
    _zone(root / "first", first, "1")
    _zone(root / "second", second, "2")
    _zone(root / "both", first, "1")
    _zone(root / "both", second, "2")
    return root


def _everything(spark, out):
    found = {name: sorted(map(str, t.collect())) for name in store.SCHEMAS
             if (t := store.load_table(spark, out, name)) is not None}
    found["catalogue"] = sorted(map(str, store.load_catalogue(spark, out).collect()))
    found["extent"] = [str(r) for r in store.load_extent(spark, out).collect()]
    found["report"] = sorted(map(str, build_report(spark, out).collect()))
    found["hot"] = sorted(store.load_hot_users(spark, out))
    return found


@pytest.fixture(scope="module")
def whole(spark, zones, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    build(spark, str(zones / "both"), out, RULE, strict=False, with_pairs=True)
    return _everything(spark, out)


def _first(spark, zones, out):
    build(spark, str(zones / "first"), out, RULE, strict=False, with_pairs=True)


def test_two_deliveries_equal_one_build(spark, zones, whole, tmp_path):
    out = str(tmp_path / "out")
    _first(spark, zones, out)
    before = {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "out" / "orders").glob("*/*.parquet")}
    t = add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    assert t.pairs.count() == len(whole["pairs"])
    assert _everything(spark, out) == whole
    assert not (tmp_path / "out" / "_delivery").exists()
    # Again, all of it are copies: the same tables, and files of the orders stay as they are.
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "orders").glob("*/*.parquet")}
    assert before and after
    add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    again = _everything(spark, out)
    assert {k: v for k, v in again.items() if k != "report"} == {k: v for k, v in whole.items() if k != "report"}
    assert after == {f: f.stat().st_mtime_ns for f in (tmp_path / "out" / "orders").glob("*/*.parquet")}


@pytest.mark.parametrize("step", ["replace_months", "replace_table", "counted"])
def test_a_run_that_was_cut_off_is_finished(spark, zones, whole, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")
    _first(spark, zones, out)
    real = getattr(delivery, step)

    def cut_off(*args):
        if step == "counted" or args[-1] == out:
            raise RuntimeError("cut off")
        return real(*args)

    monkeypatch.setattr(delivery, step, cut_off)
    with pytest.raises(RuntimeError, match="cut off"):
        add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    monkeypatch.undo()
    add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    found = _everything(spark, out)
    assert {k: v for k, v in found.items() if k != "report"} == {k: v for k, v in whole.items() if k != "report"}


def test_large_users_are_found_among_those_at_hand(spark, zones, whole, tmp_path, monkeypatch):
    from repeatwise.operators.skew import hot_users

    out = str(tmp_path / "out")
    low = lambda orders, share=0.03, floor=5, total=None: hot_users(orders, share, floor, total)
    monkeypatch.setattr("repeatwise.plans.build.hot_users", low)
    monkeypatch.setattr(delivery, "hot_users", low)
    _first(spark, zones, out)
    t = add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    found = _everything(spark, out)
    # Ranges give the same rows as the plain plan.
    assert {k: v for k, v in found.items() if k != "hot"} == {k: v for k, v in whole.items() if k != "hot"}
    assert sorted(t.hot_users) == sorted(low(t.orders))


def test_months_without_a_change_keep_their_files(spark, tmp_path):
    out = str(tmp_path / "out")
    order = lambda u, i, day: [u, i, "s", "ok", "150", day, "i", "c", "a"]
    name = f"{FILE_KEYWORDS['orders']}.csv"
    _csv(tmp_path / "a" / name, ORDERS, [order("u1", "1", "2024-01-05"), order("u1", "2", "2024-02-05"), order("u2", "3", "2024-03-05")])
    _csv(tmp_path / "b" / name, ORDERS, [order("u1", "4", "2024-04-05")])
    build(spark, str(tmp_path / "a"), out, RULE)
    files = lambda: {str(f) for f in (tmp_path / "out" / "orders").glob("*/*.parquet")}
    before = files()
    t = add_delivery(spark, str(tmp_path / "b"), out, RULE)
    # Only February holds an order that has got a successor.
    assert {f.split("order_ym=")[1][:7] for f in before - files()} == {"2024-02"}
    assert {r.sub_order_id: r.purchase_rank for r in t.orders.collect()} == {"1": 1, "2": 2, "3": 1, "4": 3}


def test_months_are_put_in_place_as_staged_and_compared_row_by_row(spark, zones, tmp_path, monkeypatch):
    out, calls, plans = str(tmp_path / "out"), [], []
    _first(spark, zones, out)
    replace, written = delivery.replace_months, delivery._written

    def spy(df, name, path):
        calls.append((path, "Rebalance" in df._jdf.queryExecution().optimizedPlan().toString()))
        replace(df, name, path)

    def spy_written(df, path):
        plans.append((path, df.columns))
        return written(df, path)

    monkeypatch.setattr(delivery, "replace_months", spy)
    monkeypatch.setattr(delivery, "_written", spy_written)
    add_delivery(spark, str(zones / "second"), out, RULE, strict=False)
    assert {(path == out, rebalance) for path, rebalance in calls} == {(True, False), (False, True)}
    assert [columns[-1] for path, columns in plans if path.endswith("/journeys")] == ["_changed"]
