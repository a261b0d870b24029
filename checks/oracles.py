"""DuckDB SQL for every query in checks.queries, over the same Parquet tables.

Labels are formed by a self join and persons by distinct counts, so the SQL does not
follow the plans it checks.
"""

from __future__ import annotations

# --- shared tables -----------------------------------------------------------

JOINED = """lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

DISCOUNT = """CASE WHEN l_discount >= 0.05 THEN 'PLAT-' || l_returnflag || '-1,2' || l_linenumber
    || '0.50;SHOP-' || l_linenumber || '; junk' ELSE '' END"""

CTES = {}

CTES["retail"] = f"""
  SELECT o_custkey::VARCHAR AS user_id, l_orderkey || '-' || l_linenumber AS sub_order_id,
    p_brand AS sku, s_name AS influencer_name,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'shipped' ELSE 'closed' END AS order_status,
    l_returnflag AS after_sale_status, l_extendedprice::DECIMAL(18,2) AS gmv,
    o_orderdate + to_hours(l_linenumber * 3) AS pay_time, p_type AS category,
    CASE WHEN r_regionkey IN (0, 1) THEN 'self' ELSE 'influencer' END AS channel_type,
    {DISCOUNT} AS platform_discount,
    (o_orderdate + to_hours(l_linenumber * 3))::DATE AS order_date,
    strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y-%m') AS order_ym
  FROM {JOINED}
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1"""

DAY = "86400000000"


def _labelled(min_amount=20000, min_days=1, window=365, channels=()):
    where = f"order_status IN ('completed', 'shipped') AND gmv >= {min_amount}"
    if channels:
        where += " AND channel_type IN (" + ", ".join(f"'{c}'" for c in channels) + ")"
    return f"""
  SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY pay_time, sub_order_id) AS purchase_rank,
    CASE WHEN r.id IS NOT NULL THEN 'returning' ELSE 'new' END AS customer_type,
    CASE WHEN pay_time >= first_time + to_days({min_days}) THEN 'returning' ELSE 'new' END AS customer_type_lifetime
  FROM retail o
  LEFT JOIN (SELECT DISTINCT a.sub_order_id AS id FROM retail a
    JOIN (SELECT user_id, pay_time FROM retail WHERE {where}) q USING (user_id)
    WHERE a.pay_time >= q.pay_time
      AND (epoch_us(a.pay_time) - epoch_us(q.pay_time)) // {DAY} BETWEEN {min_days} AND {window}) r
    ON r.id = o.sub_order_id
  LEFT JOIN (SELECT user_id, min(pay_time) AS first_time FROM retail WHERE {where} GROUP BY 1) f
    USING (user_id)"""


CTES["labelled"] = _labelled()
CTES["pairs"] = f"""
  SELECT user_id, customer_type, customer_type_lifetime, order_ym AS from_ym, order_date AS from_date,
    influencer_name AS from_influencer, sku AS from_sku, purchase_rank AS from_rank, gmv AS from_gmv,
    order_status AS from_status, category AS from_category, channel_type AS from_channel_type,
    to_ym, to_date, to_influencer, to_sku, purchase_rank + 1 AS to_rank, to_gmv, to_status,
    to_category, to_channel_type,
    (epoch_us(to_time) - epoch_us(pay_time)) // {DAY} AS days_between
  FROM (SELECT *, lead(pay_time) OVER w AS to_time, lead(order_ym) OVER w AS to_ym,
      lead(order_date) OVER w AS to_date, lead(influencer_name) OVER w AS to_influencer,
      lead(sku) OVER w AS to_sku, lead(gmv) OVER w AS to_gmv, lead(order_status) OVER w AS to_status,
      lead(category) OVER w AS to_category, lead(channel_type) OVER w AS to_channel_type
    FROM labelled WINDOW w AS (PARTITION BY user_id ORDER BY pay_time, sub_order_id))
  WHERE to_time IS NOT NULL"""
CTES["scoped"] = "SELECT * FROM labelled WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
CTES["prev"] = "SELECT * FROM labelled WHERE order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"
CTES["spans"] = """
  SELECT 'current' AS span, * FROM scoped UNION ALL SELECT 'previous' AS span, * FROM prev"""
CTES["spairs"] = "SELECT * FROM pairs WHERE from_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
CTES["samples"] = """
  SELECT user_id, sub_order_id, category AS sample_type, sku, order_status, gmv, pay_time,
    order_date, order_ym FROM retail WHERE after_sale_status = 'R' AND gmv < 8000"""
CTES["members"] = """
  SELECT c_custkey::VARCHAR AS user_id, TIMESTAMP '1995-01-01' + to_days((c_custkey % 2400)::INT) AS join_time
  FROM customer WHERE c_acctbal > 0"""
CTES["crowds"] = """
  SELECT c_mktsegment AS crowd_name, c_custkey::VARCHAR AS user_id FROM customer
  UNION ALL SELECT 'NATION_' || c_nationkey, c_custkey::VARCHAR FROM customer"""

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
CTES["raw"] = f"""
  SELECT {LINE},
    CASE WHEN l_linenumber = 7 AND l_orderkey % 10 = 0 THEN NULL
      WHEN l_orderkey % 11 = 0 THEN '  ' || o_custkey || ' '
      WHEN l_orderkey % 11 = 1 THEN chr(9) || o_custkey || chr(12288) || chr(160) || chr(10)
      ELSE o_custkey::VARCHAR END AS user_id,
    CASE WHEN l_orderkey % 13 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'None' END
      ELSE l_orderkey || '-' || l_linenumber END AS sub_order_id,
    CASE WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN 'nan'
      WHEN l_linenumber = 3 AND l_orderkey % 7 = 0 THEN '  '
      WHEN l_linenumber = 3 AND l_orderkey % 7 = 1 THEN chr(9) || chr(8195) ELSE ' ' || p_brand END AS sku,
    CASE WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN NULL ELSE s_name END AS influencer_name,
    CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE o_orderstatus END AS order_status,
    CASE l_linenumber WHEN 1 THEN '-' WHEN 2 THEN 'None' WHEN 3 THEN 'nan' WHEN 4 THEN '' ELSE l_returnflag END AS after_sale_status,
    CASE l_orderkey % 19 WHEN 0 THEN '12d' WHEN 1 THEN '1,000' WHEN 2 THEN ' 123.45 ' WHEN 3 THEN '1.5e3'
      WHEN 4 THEN chr(160) || l_extendedprice::DECIMAL(18,2)::VARCHAR || chr(9)
      ELSE l_extendedprice::DECIMAL(18,2)::VARCHAR END AS payable_amount,
    CASE l_orderkey % 23 WHEN 0 THEN 'bad' WHEN 1 THEN NULL
      WHEN 2 THEN strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y/%-m/%-d %-H:%M')
      WHEN 3 THEN strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y%m%d %H:%M:%S')
      WHEN 4 THEN strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y.%-m.%-d')
      WHEN 5 THEN strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y-%m-%d  %-I:%M:%S %p')
      ELSE strftime(o_orderdate + to_hours(l_linenumber * 3), '%Y-%m-%d %H:%M:%S') END AS pay_time,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_submit_time,
    CASE WHEN l_linenumber = 5 THEN 'nan' ELSE p_type END AS category,
    CASE WHEN l_linenumber = 6 THEN '' WHEN r_regionkey IN (0, 1) THEN 'self' ELSE 'influencer' END AS channel_type,
    CASE WHEN l_linenumber = 1 THEN '-' ELSE {DISCOUNT} END AS platform_discount
  FROM {JOINED}"""
CTES["timed"] = """
  SELECT * REPLACE (coalesce(try_strptime(pay_time, '%Y-%m-%d %H:%M:%S'),
      try_strptime(pay_time, '%Y/%m/%d %H:%M'), try_strptime(pay_time, '%Y%m%d %H:%M:%S'),
      try_strptime(pay_time, '%Y.%m.%d'), try_strptime(pay_time, '%Y-%m-%d  %I:%M:%S %p')) AS pay_time,
    strptime(order_submit_time, '%Y-%m-%d %H:%M:%S') AS order_submit_time)
  FROM raw"""


def strip(x):
    """By character classes, where the engine lists the characters."""
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _text(column, tokens, default):
    listed = ", ".join(f"'{t}'" for t in tokens)
    return (f"CASE WHEN {column} IS NULL OR {strip(column)} IN ({listed}) THEN '{default}' "
            f"ELSE {strip(column)} END AS {column}")


MONEY = f"""CASE WHEN regexp_full_match({strip('payable_amount')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
  THEN CAST({strip('payable_amount')} AS DECIMAL(18,2)) ELSE 0::DECIMAL(18,2) END"""
CTES["norm"] = f"""
  SELECT {LINE}, {strip('user_id')} AS user_id, {_text('sub_order_id', ('nan', 'None'), '')},
    {_text('sku', ('nan', ''), 'unknown')}, {_text('influencer_name', ('nan', ''), 'shelf')},
    {_text('order_status', ('nan', ''), 'unknown')},
    {_text('after_sale_status', ('nan', '', '-', 'None'), 'none')},
    {_text('category', ('nan', ''), 'unclassified')}, {_text('channel_type', ('nan', ''), 'unknown')},
    {_text('platform_discount', ('nan', '-', 'None'), '')},
    {MONEY} AS gmv, pay_time, order_submit_time, pay_time::DATE AS order_date,
    strftime(pay_time, '%Y-%m') AS order_ym
  FROM timed WHERE pay_time IS NOT NULL AND user_id IS NOT NULL"""
CTES["cleaned"] = f"""
  SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY
    CASE WHEN sub_order_id <> '' THEN sub_order_id END,
    CASE WHEN sub_order_id = '' THEN user_id END, CASE WHEN sub_order_id = '' THEN pay_time END,
    CASE WHEN sub_order_id = '' THEN sku END, CASE WHEN sub_order_id = '' THEN influencer_name END
    ORDER BY {LINE}) = 1"""
CTES["rawsamples"] = f"""
  SELECT {LINE}, {strip('user_id')} AS user_id, {_text('sub_order_id', ('nan', 'None'), '')},
    {_text('category', ('nan', '', 'None', '-'), 'unknown')},
    {_text('sku', ('nan', '', 'None', '-'), 'unknown')},
    {_text('after_sale_status', ('nan', '', 'None', '-'), 'unknown')},
    {MONEY} AS gmv, coalesce(pay_time, order_submit_time) AS pay_time
  FROM timed WHERE payable_amount IN ('12d', ' 123.45 ', '1.5e3') AND user_id IS NOT NULL"""
CTES["cleansamples"] = f"""
  SELECT *, strftime(pay_time, '%Y-%m') AS order_ym FROM rawsamples
  QUALIFY row_number() OVER (PARTITION BY
    CASE WHEN sub_order_id <> '' THEN sub_order_id END,
    CASE WHEN sub_order_id = '' THEN user_id END, CASE WHEN sub_order_id = '' THEN pay_time END,
    CASE WHEN sub_order_id = '' THEN sku END, CASE WHEN sub_order_id = '' THEN category END
    ORDER BY {LINE}) = 1"""

NEEDS = {
    "retail": (), "labelled": ("retail",), "pairs": ("labelled",), "scoped": ("labelled",),
    "prev": ("labelled",), "spans": ("scoped", "prev"), "spairs": ("pairs",),
    "samples": ("retail",), "members": (), "crowds": (), "raw": (), "timed": ("raw",),
    "norm": ("timed",), "cleaned": ("norm",), "rawsamples": ("timed",),
    "cleansamples": ("rawsamples",),
}


def sql(needs: str, body: str, **extra: str) -> str:
    """Body with the shared tables it needs in front; `extra` adds further ones."""
    order: list[str] = []

    def visit(name):
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# --- shared expressions ------------------------------------------------------

def rnd(x, digits):
    s = float(10 ** digits)
    return f"round_even(({x})::DOUBLE * {s}::DOUBLE, 0) / {s}::DOUBLE"


def per(n, d):
    return f"(({n})::DOUBLE / (CASE WHEN ({d}) = 0 THEN 1 ELSE ({d})::DOUBLE END))"


def pct(n, d):
    return f"({per(n, d)} * 100::DOUBLE)"


def change(cur, prev):
    return (f"CASE WHEN ({prev}) <> 0 THEN (({cur})::DOUBLE - ({prev})::DOUBLE) "
            f"/ abs(({prev})::DOUBLE) * 100::DOUBLE END")


def agg(src, *keys):
    """Measures per group, persons as distinct users."""
    cols = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""(SELECT *, orders - new_orders AS returning_orders, gmv - new_gmv AS returning_gmv,
      buyers - new_buyers AS returning_buyers FROM (SELECT {cols}
      count(*) AS orders, coalesce(sum(gmv), 0) AS gmv, count(DISTINCT user_id) AS buyers,
      count(*) FILTER (customer_type = 'new') AS new_orders,
      coalesce(sum(gmv) FILTER (customer_type = 'new'), 0) AS new_gmv,
      count(DISTINCT user_id) FILTER (customer_type = 'new') AS new_buyers,
      count(DISTINCT user_id) FILTER (customer_type = 'returning') AS any_returning_buyers
      FROM {src} {group}))"""


def or_zero(x, n):
    return f"CASE WHEN {n} > 0 THEN {x} ELSE 0::DOUBLE END"


HEADLINES = {f"{p}{m}": f"{p}{m}" + ("::DOUBLE" if m == "gmv" else "")
             for m in ("orders", "gmv", "buyers") for p in ("", "new_", "returning_")}
for _p in ("", "new_", "returning_"):
    HEADLINES[f"{_p}frequency"] = or_zero(rnd(per(f"{_p}orders", f"{_p}buyers"), 2), f"{_p}buyers")
for _p in ("", "new_", "returning_"):
    HEADLINES[f"{_p}per_buyer"] = or_zero(rnd(per(f"{_p}gmv", f"{_p}buyers"), 0), f"{_p}buyers")
for _p in ("new_", "returning_"):
    HEADLINES[f"{_p}share"] = or_zero(rnd(pct(f"{_p}buyers", "buyers"), 1), "buyers")

SHOWN = f"""orders, buyers, gmv::DOUBLE AS gmv, {rnd(per('gmv', 'buyers'), 0)} AS per_buyer,
  {rnd(per('orders', 'buyers'), 2)} AS frequency, new_buyers, returning_buyers,
  {rnd(pct('new_buyers', 'buyers'), 1)} AS new_share,
  {rnd(pct('returning_buyers', 'buyers'), 1)} AS returning_share,
  {rnd(per('new_gmv', 'new_buyers'), 0)} AS new_per_buyer,
  {rnd(per('returning_gmv', 'returning_buyers'), 0)} AS returning_per_buyer,
  new_orders, returning_orders, new_gmv::DOUBLE AS new_gmv, returning_gmv::DOUBLE AS returning_gmv"""


def by_type(src, metric, *keys):
    """Value per group and customer type."""
    k = ", ".join(keys)
    if metric == "buyers":
        g = agg(src, *keys)
        return f"""(SELECT {k}, 'new' AS customer_type, new_buyers::DOUBLE AS value FROM {g}
          UNION ALL SELECT {k}, 'returning', returning_buyers::DOUBLE FROM {g})"""
    v = "sum(gmv)::DOUBLE" if metric == "gmv" else "count(*)::DOUBLE"
    return f"(SELECT {k}, customer_type, {v} AS value FROM {src} GROUP BY {k}, customer_type)"


def summary_rows(src, *keys):
    k = "".join(f"{x}, " for x in keys)
    g = agg(src, *keys)
    rows = []
    for name, p in (("total", ""), ("new", "new_"), ("returning", "returning_")):
        rows.append(f"""SELECT {k}'{name}' AS type, {p}orders AS orders, {p}buyers AS buyers,
          {rnd(f'{p}gmv', 0)} AS gmv,
          {or_zero(rnd(per(f'{p}gmv', f'{p}buyers'), 0), f'{p}buyers')} AS per_buyer FROM {g}""")
    return "(" + " UNION ALL ".join(rows) + ")"


def side(column, span):
    return f"coalesce(max(CASE WHEN span = '{span}' THEN {column}::DOUBLE END), 0::DOUBLE)"


O: dict[str, str] = {}

# --- sources and catalogue ---------------------------------------------------

O["s1_landing_stack"] = """
  SELECT 'nation.parquet' AS file, count(*) AS n_rows, count(n_name) AS n_names, 0::BIGINT AS n_convs FROM nation
  UNION ALL SELECT 'conversations.parquet', count(*), 0::BIGINT, count(conv_id) FROM conversations"""
O["s2_source_inventory"] = """
  SELECT 'orders' AS source, true AS available, count(*) AS n_rows FROM orders
  UNION ALL SELECT 'samples', false, 0::BIGINT
  UNION ALL SELECT 'members', true, count(*) FROM customer
  UNION ALL SELECT 'crowds', true, count(*) FROM labels"""
O["s3_all_string_read"] = """
  SELECT count(*) AS n_rows, sum(length(c_custkey::VARCHAR))::BIGINT AS key_chars,
    sum(length(c_name))::BIGINT AS name_chars, max(c_acctbal) AS max_balance FROM customer"""
O["s4_rename_and_keep"] = sql("raw", """
  SELECT 12::BIGINT AS n_columns, count(*) AS n_rows, count(user_id) AS n_users, count(sku) AS n_skus,
    count(pay_time) AS n_times FROM raw""")
O["s5_save_tables"] = sql("labelled pairs samples members crowds", """
  SELECT 'orders' AS table_name, count(*) AS n_rows FROM labelled
  UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'samples', count(*) FROM samples
  UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'crowds', count(*) FROM crowds""")
O["s6_load_tables"] = sql("labelled", """
  SELECT order_ym, customer_type, count(*) AS n_orders, sum(gmv)::DOUBLE AS gmv,
    min(order_date) AS first_day, max(purchase_rank) AS top_rank
  FROM labelled GROUP BY 1, 2""")
_dims = ("sku", "influencer_name", "order_status", "after_sale_status", "category", "channel_type")
O["s7_catalogue"] = sql("retail", " UNION ALL ".join(
    [f"SELECT DISTINCT '{d}' AS kind, NULL::VARCHAR AS parent, {d} AS value FROM retail" for d in _dims]
    + ["SELECT DISTINCT 'channel_type/influencer_name', channel_type, influencer_name FROM retail",
       "SELECT DISTINCT 'category/sku', category, sku FROM retail"]))
O["s7_extent"] = sql("retail", """
  SELECT min(order_date) AS date_min, max(order_date) AS date_max, max(gmv)::DOUBLE AS gmv_max,
    count(*) AS total_rows, count(DISTINCT user_id) AS total_users FROM retail""")


def _cleaned_labels(name, min_amount, min_days, window):
    return f"""
  SELECT '{name}' AS labels, order_ym, customer_type, count(*) AS n_orders, sum(gmv)::DOUBLE AS gmv
  FROM (SELECT order_ym, gmv, CASE WHEN EXISTS (SELECT 1 FROM cleaned q WHERE q.user_id = o.user_id
      AND q.order_status IN ('F', 'O') AND q.gmv >= {min_amount} AND o.pay_time >= q.pay_time
      AND (epoch_us(o.pay_time) - epoch_us(q.pay_time)) // {DAY} BETWEEN {min_days} AND {window})
    THEN 'returning' ELSE 'new' END AS customer_type FROM cleaned o) GROUP BY 2, 3"""


O["s9_build_and_relabel"] = sql("cleaned", _cleaned_labels("built", 20000, 1, 365) + " UNION ALL "
                                + _cleaned_labels("again", 40000, 30, 180))
O["s10_build_in_two_deliveries"] = sql("cleaned", f"""
  SELECT order_ym, customer_type, count(*) AS n_orders, sum(gmv)::DOUBLE AS gmv,
    count(following) AS n_pairs, max(place) AS top_rank
  FROM (SELECT order_ym, gmv, CASE WHEN EXISTS (SELECT 1 FROM cleaned q WHERE q.user_id = o.user_id
      AND q.order_status IN ('F', 'O') AND q.gmv >= 20000 AND o.pay_time >= q.pay_time
      AND (epoch_us(o.pay_time) - epoch_us(q.pay_time)) // {DAY} BETWEEN 1 AND 365)
    THEN 'returning' ELSE 'new' END AS customer_type,
    lead(pay_time) OVER line AS following, row_number() OVER line AS place
    FROM cleaned o WINDOW line AS (PARTITION BY user_id ORDER BY pay_time, sub_order_id, sku, influencer_name))
  GROUP BY 1, 2""")
O["s8_csv_export"] = sql("scoped", f"""
  SELECT influencer_name, orders, buyers, gmv::DOUBLE AS gmv, {rnd(per('gmv', 'buyers'), 0)} AS per_buyer
  FROM {agg('scoped', 'influencer_name')}""")

# --- cleaning ----------------------------------------------------------------

O["c1_time_coercion"] = sql("timed", """
  SELECT strftime(pay_time, '%Y-%m') AS order_ym, count(*) AS n_rows, max(pay_time) AS latest
  FROM timed GROUP BY 1""")
O["c2_time_fallback_whole"] = sql("timed", """
  SELECT 'some pay times' AS variant, count(*) AS n_rows, min(pay_time) AS first_time, max(pay_time) AS last_time
  FROM timed WHERE pay_time IS NOT NULL AND user_id IS NOT NULL
  UNION ALL SELECT 'no pay time', count(*), min(order_submit_time), max(order_submit_time)
  FROM timed WHERE user_id IS NOT NULL""")
O["c3_time_fallback_row"] = sql("timed", """
  SELECT strftime(coalesce(pay_time, order_submit_time), '%Y-%m') AS order_ym, count(*) AS n_rows,
    min(coalesce(pay_time, order_submit_time)) AS first_time
  FROM timed WHERE user_id IS NOT NULL GROUP BY 1""")
O["c4_drop_incomplete"] = sql("norm", """
  SELECT user_id, count(*) AS n_rows, min(pay_time) AS first_time FROM norm GROUP BY 1""")
O["c5_numeric_coercion"] = sql("norm", """
  SELECT order_ym, count(*) FILTER (gmv = 0) AS n_zero, count(*) FILTER (gmv = 1500) AS n_scientific,
    count(*) FILTER (gmv = 123.45) AS n_padded, sum(gmv)::DOUBLE AS gmv FROM norm GROUP BY 1""")
O["c6_null_tokens"] = sql("norm", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_rows FROM norm GROUP BY {c}"
    for c in (*_dims, "platform_discount")))
O["c7_absent_columns"] = sql("norm", """
  SELECT 'none' AS after_sale_status, 'unclassified' AS category, 'unknown' AS channel_type,
    '' AS platform_discount, 0::DOUBLE AS gmv, order_ym, count(*) AS n_rows FROM norm GROUP BY order_ym""")
O["c8_dedup_orders"] = sql("cleaned", """
  SELECT sub_order_id, user_id, sku, influencer_name, pay_time, gmv::DOUBLE AS gmv FROM cleaned""")
O["c9_dedup_samples"] = sql("cleansamples", """
  SELECT sub_order_id, user_id, category AS sample_type, sku, after_sale_status AS merchant_code,
    pay_time, order_ym, gmv::DOUBLE AS gmv FROM cleansamples""")
O["c10_members"] = """
  WITH m AS (SELECT trim(CASE o_orderkey % 29 WHEN 0 THEN 'nan' WHEN 1 THEN ' '
      WHEN 2 THEN ' ' || o_custkey ELSE o_custkey::VARCHAR END) AS user_id,
    CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS t FROM orders)
  SELECT user_id, min(t) AS join_time, strftime(min(t), '%Y-%m') AS join_ym
  FROM m WHERE user_id NOT IN ('nan', '', 'None') GROUP BY 1"""
O["c11_crowds"] = """
  SELECT DISTINCT CASE WHEN o_orderkey % 31 IN (0, 1) THEN 'unnamed' ELSE o_orderpriority END AS crowd_name,
    o_custkey::VARCHAR AS user_id FROM orders WHERE o_orderkey % 37 <> 0"""
O["c12_derived_dates"] = sql("cleaned", """
  SELECT order_date, order_ym, count(*) AS n_rows FROM cleaned GROUP BY 1, 2""")

# --- labels and sequences ----------------------------------------------------

O["l1_qualifying"] = sql("retail", """
  SELECT order_status, channel_type,
    count(*) FILTER (order_status IN ('completed', 'shipped') AND gmv >= 20000 AND channel_type = 'self') AS n_qualifying,
    count(*) AS n_orders FROM retail GROUP BY 1, 2""")
O["l2_first_qualifying"] = sql("retail", """
  SELECT user_id, pay_time AS first_qualify_time, influencer_name AS first_qualify_influencer,
    sku AS first_qualify_sku, gmv::DOUBLE AS first_qualify_gmv FROM retail
  WHERE order_status IN ('completed', 'shipped') AND gmv >= 20000
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pay_time, sub_order_id) = 1""")
O["l3_lifetime_label"] = sql("labelled", "SELECT sub_order_id, customer_type_lifetime FROM labelled")
O["l4_rolling_label"] = sql("labelled", "SELECT sub_order_id, customer_type FROM labelled")
O["l4_rolling_label_events"] = f"""
  WITH r AS (SELECT DISTINCT a.event_id FROM events a JOIN events q USING (user_id)
    WHERE q.value >= 10 AND a.ts >= q.ts
      AND (epoch_us(a.ts) - epoch_us(q.ts)) // {DAY} BETWEEN 2 AND 7)
  SELECT event_id, CASE WHEN r.event_id IS NOT NULL THEN 'returning' ELSE 'new' END AS customer_type
  FROM events LEFT JOIN r USING (event_id)"""
O["l5_relabel"] = sql("retail", """
  SELECT order_ym, customer_type, count(*) AS n_orders, sum(gmv)::DOUBLE AS gmv
  FROM relabelled GROUP BY 1, 2""", relabelled=_labelled(40000, 30, 180, ("self",)))
O["l6_pair_labels"] = sql("pairs", """
  SELECT customer_type, customer_type_lifetime, from_channel_type, count(*) AS n_pairs,
    sum(days_between)::BIGINT AS n_days FROM pairs GROUP BY 1, 2, 3""")
O["l7_purchase_rank"] = sql("labelled", "SELECT sub_order_id, purchase_rank FROM labelled")
O["l8_purchase_pairs"] = sql("pairs", """
  SELECT * REPLACE (from_gmv::DOUBLE AS from_gmv, to_gmv::DOUBLE AS to_gmv) FROM pairs""")
O["l4_rolling_label_in_ranges"] = O["l4_rolling_label"]
O["l8_purchase_pairs_in_ranges"] = O["l8_purchase_pairs"]
O["l9_canonical_label"] = sql("labelled", """
  SELECT customer_type, customer_type_lifetime, count(*) AS n_orders, count(DISTINCT user_id) AS n_users
  FROM labelled GROUP BY 1, 2""")

# --- filters -----------------------------------------------------------------

_full = """order_date BETWEEN DATE '1998-03-01' AND DATE '2000-06-30' AND category IN ('PROMO', 'SMALL')
  AND channel_type IN ('influencer') AND order_status IN ('completed', 'shipped')
  AND after_sale_status IN ('N', 'R') AND gmv BETWEEN 1000 AND 60000.5"""
O["f1_scope_filter"] = sql("retail", f"""
  SELECT sku, count(*) AS orders, sum(gmv)::DOUBLE AS gmv FROM retail WHERE {_full}
    AND sku IN ('Brand#1', 'Brand#2', 'Brand#3')
    AND influencer_name IN (SELECT s_name FROM supplier WHERE s_suppkey BETWEEN 10 AND 59) GROUP BY 1""")
O["f2_sku_keyword"] = sql("retail", """
  SELECT sku, count(*) AS orders, sum(gmv)::DOUBLE AS gmv FROM retail
  WHERE contains(lower(sku), lower('D#1')) GROUP BY 1""")
O["f3_linked_influencers"] = sql("retail", "SELECT DISTINCT influencer_name FROM retail WHERE channel_type = 'self'")
O["f3_linked_skus"] = sql("retail", "SELECT DISTINCT sku FROM retail")
O["f3_catalogue_influencers"], O["f3_catalogue_skus"] = O["f3_linked_influencers"], O["f3_linked_skus"]
O["f4_year_ago"] = sql("spans", """
  SELECT span, category, count(*) AS orders, sum(gmv)::DOUBLE AS gmv FROM spans GROUP BY 1, 2""")
O["f5_pair_scope"] = sql("spairs", """
  SELECT from_sku, customer_type, count(*) AS n_pairs, sum(days_between)::BIGINT AS n_days FROM spairs
  WHERE from_channel_type = 'self' AND contains(lower(from_sku), 'd#1') AND from_gmv >= 5000 GROUP BY 1, 2""")
O["f5_pair_scope_linked_keyword"] = sql("spairs pairs", """
  SELECT from_sku, from_category, count(*) AS n_pairs FROM spairs WHERE from_sku IN (
    SELECT from_sku FROM pairs WHERE from_category = 'PROMO' AND contains(lower(from_sku), 'd#1')) GROUP BY 1, 2""")
O["f6_sku_regex"] = sql("scoped", """
  SELECT sku, count(*) AS orders FROM scoped WHERE regexp_matches(sku, 'brand#(1|2)[0-3]$', 'i') GROUP BY 1""")
O["f7_user_membership"] = sql("scoped members", """
  SELECT order_ym, count(*) AS orders, sum(gmv)::DOUBLE AS gmv FROM scoped
  WHERE user_id IN (SELECT user_id FROM members) GROUP BY 1""")

# --- headline, channel, trend, product ---------------------------------------

O["k1_kpi"] = sql("scoped", "SELECT " + ", ".join(f"{v} AS {k}" for k, v in HEADLINES.items())
                  + f" FROM {agg('scoped')}")
O["k1_kpi_in_ranges"] = O["k1_kpi"]
_cur = ", ".join(f"{v} AS {k}" for k, v in HEADLINES.items())
O["k2_kpi_delta"] = sql("scoped prev", " UNION ALL ".join(
    f"""SELECT '{k}' AS measure, c.{k}::DOUBLE AS current_value, p.{k}::DOUBLE AS previous_value,
    c.{k}::DOUBLE - p.{k}::DOUBLE AS delta, {change(f'c.{k}', f'p.{k}')} AS delta_pct FROM cur c, pre p"""
    for k in HEADLINES),
    cur=f"SELECT {_cur} FROM {agg('scoped')}", pre=f"SELECT {_cur} FROM {agg('prev')}")
O["k3_channel_summary"] = sql("scoped", f"SELECT channel_type, {SHOWN} FROM {agg('scoped', 'channel_type')}")
_inf = "(SELECT * FROM scoped WHERE influencer_name IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003'))"
O["k3_influencer_summary"] = sql("scoped", f"SELECT influencer_name, {SHOWN} FROM {agg(_inf, 'influencer_name')}")
O["k4_channel_shares"] = sql("scoped", f"""
  SELECT channel_type, orders, gmv::DOUBLE AS gmv, buyers,
    {pct('orders', 'sum(orders) OVER ()')} AS orders_share,
    {pct('gmv', 'sum(gmv) OVER ()')} AS gmv_share,
    {pct('buyers', 'sum(buyers) OVER ()')} AS buyers_share FROM {agg('scoped', 'channel_type')}""")
O["k5_channel_listing"] = sql("spans", f"SELECT span, channel_type, {SHOWN} FROM {agg('spans', 'span', 'channel_type')}")
_k5 = ("orders", "buyers", "gmv", "per_buyer")
O["k5_channel_change"] = sql("spans", "SELECT *, " + ", ".join(
    f"{change(f'{c}_current', f'{c}_previous')} AS {c}_change_pct" for c in _k5)
    + " FROM (SELECT influencer_name, " + ", ".join(
        f"{side(c, s)} AS {c}_{s}" for c in _k5 for s in ("current", "previous"))
    + f" FROM (SELECT span, influencer_name, {SHOWN} FROM {agg('spans', 'span', 'influencer_name')}) GROUP BY 1)")
O["t1_trend_daily_orders"] = sql("scoped", f"SELECT * FROM {by_type('scoped', 'orders', 'order_date')}")
O["t1_trend_monthly_gmv"] = sql("scoped", f"SELECT * FROM {by_type('scoped', 'gmv', 'order_ym')}")
O["t1_trend_monthly_buyers_by_channel"] = sql(
    "scoped", f"SELECT * FROM {by_type('scoped', 'buyers', 'order_ym', 'channel_type')}")


def shared(src, keys):
    k = ", ".join(keys)
    total = f"sum(value) OVER (PARTITION BY {k})"
    return f"(SELECT {k}, customer_type, {rnd(pct('value', total), 2)} AS value FROM {src})"


O["t2_trend_share"] = sql("scoped", "SELECT * FROM " + shared(
    by_type("scoped", "gmv", "order_ym", "influencer_name"), ("order_ym", "influencer_name")))
O["t3_trend_year_on_year_daily"] = sql("spans", f"""
  SELECT span, CASE WHEN span = 'previous' THEN (order_date + INTERVAL 1 YEAR)::DATE ELSE order_date END AS order_date,
    coalesce(sum(value) FILTER (customer_type = 'new'), 0) AS new,
    coalesce(sum(value) FILTER (customer_type = 'returning'), 0) AS returning
  FROM {by_type('spans', 'buyers', 'span', 'order_date')} GROUP BY 1, 2""")
_month = "(left(order_ym, 4)::INT + 1)::VARCHAR || substr(order_ym, 5)"
O["t4_trend_pivot_monthly"] = sql("spans", f"""
  SELECT span, CASE WHEN span = 'previous' THEN {_month} ELSE order_ym END AS order_ym,
    coalesce(sum(value) FILTER (customer_type = 'new'), 0) AS new,
    coalesce(sum(value) FILTER (customer_type = 'returning'), 0) AS returning
  FROM {shared(by_type('spans', 'orders', 'span', 'order_ym'), ('span', 'order_ym'))} GROUP BY 1, 2""")
O["t5_trend_summary"] = sql("scoped", f"SELECT * FROM {summary_rows('scoped')}")
O["t6_trend_summary_compare"] = sql("spans", "SELECT *, "
    + ", ".join(f"{c}_current - {c}_previous AS {c}_delta" for c in _k5) + ", "
    + ", ".join(f"{change(f'{c}_current', f'{c}_previous')} AS {c}_delta_pct" for c in _k5)
    + " FROM (SELECT type, " + ", ".join(
        f"{side(c, s)} AS {c}_{s}" for c in _k5 for s in ("current", "previous"))
    + f" FROM {summary_rows('spans', 'span')} GROUP BY 1)")
_periods = f"""orders, buyers, {rnd('gmv', 0)} AS gmv, {rnd(per('gmv', 'buyers'), 0)} AS per_buyer, new_buyers,
  returning_buyers, {rnd('new_gmv', 0)} AS new_gmv, {rnd('returning_gmv', 0)} AS returning_gmv"""
O["t7_trend_periods"] = sql("scoped", f"SELECT order_date, {_periods} FROM {agg('scoped', 'order_date')}")
O["t7_trend_periods_by_influencer"] = sql(
    "scoped", f"SELECT order_ym, influencer_name, {_periods} FROM {agg('scoped', 'order_ym', 'influencer_name')}")
O["t8_trend_detail"] = sql("scoped", " UNION ALL ".join(
    f"""SELECT order_date, '{t}' AS customer_type, {t}_orders AS orders, {rnd(f'{t}_gmv', 2)} AS gmv,
    {t}_buyers AS buyers FROM {agg('scoped', 'order_date')} WHERE {t}_orders > 0""" for t in ("new", "returning")))
for _m, _total in (("gmv", "sum(gmv)"), ("buyers", "count(DISTINCT user_id)")):
    O[f"p1_product_rank_{_m}"] = sql("scoped", f"""
      SELECT sku, {_m}::DOUBLE AS total, {rnd(pct(_m, f'(SELECT {_total} FROM scoped)'), 2)} AS store_share
      FROM {agg('scoped', 'sku')} ORDER BY total DESC, sku LIMIT 50""")
    O[f"p2_product_split_{_m}"] = sql("scoped", f"""
      SELECT sku, new_{_m}::DOUBLE AS new, returning_{_m}::DOUBLE AS returning, {_m}::DOUBLE AS total,
        {pct(f'new_{_m}', _m)} AS new_pct, {pct(f'returning_{_m}', _m)} AS returning_pct
      FROM {agg('scoped', 'sku')}""")
O["p3_product_table"] = sql("scoped", f"""
  SELECT sku, ({rnd('gmv', 0)})::BIGINT AS gmv, {rnd(pct('gmv', '(SELECT sum(gmv) FROM scoped)'), 2)} AS gmv_store_share,
    ({rnd('new_gmv', 0)})::BIGINT AS new_gmv, ({rnd('returning_gmv', 0)})::BIGINT AS returning_gmv,
    {rnd(pct('new_gmv', 'gmv'), 2)} AS new_gmv_share, {rnd(pct('returning_gmv', 'gmv'), 2)} AS returning_gmv_share,
    buyers, {rnd(pct('buyers', '(SELECT count(DISTINCT user_id) FROM scoped)'), 2)} AS buyers_store_share,
    new_buyers, any_returning_buyers AS returning_buyers,
    {rnd(pct('new_buyers', 'buyers'), 2)} AS new_buyers_share,
    {rnd(pct('any_returning_buyers', 'buyers'), 2)} AS returning_buyers_share
  FROM {agg('scoped', 'sku')}""")

# --- repurchase --------------------------------------------------------------

_old = "user_id IN (SELECT user_id FROM scoped WHERE customer_type = 'returning')"


def cycle(by, minimum):
    return f"""(SELECT from_{by}, to_{by}, sum(days_between)::DOUBLE / count(*)::DOUBLE AS avg_days,
      count(*) AS n_moves FROM spairs WHERE {_old} GROUP BY 1, 2 HAVING count(*) >= {minimum})"""


O["r1_cycle_influencer"] = sql("scoped spairs", f"SELECT * FROM {cycle('influencer', 2)}")
O["r1_cycle_sku"] = sql("scoped spairs", f"SELECT * FROM {cycle('sku', 5)}")
_brands = [f"Brand#{i}" for i in range(1, 26)]
O["r2_cycle_matrix"] = sql("scoped spairs", "SELECT from_sku, " + ", ".join(
    f"max(CASE WHEN to_sku = '{b}' THEN {rnd('avg_days', 1)} END) AS to_{b.lower().replace('#', '_')}" for b in _brands)
    + f" FROM {cycle('sku', 5)} GROUP BY 1")

O["r2_cycle_rows"] = sql("scoped spairs", f"""
  SELECT from_sku, count(*) AS n_values,
    string_agg(to_sku || '=' || round({rnd('avg_days', 1)} * 10)::BIGINT, ';' ORDER BY to_sku) AS tenths
  FROM {cycle('sku', 5)} GROUP BY 1""")
O["c4_rejected_rows"] = sql("timed", """
  SELECT CASE WHEN pay_time IS NULL THEN 'no readable time' ELSE 'no user' END AS reason, count(*) AS n_rows
  FROM timed WHERE pay_time IS NULL OR user_id IS NULL GROUP BY 1""")


def entry(cond="true"):
    return f"SELECT DISTINCT user_id, order_ym FROM scoped WHERE customer_type = 'new' AND {cond}"


def repeats(cond="true"):
    return (f"SELECT * FROM spairs WHERE customer_type = 'new' AND {cond} "
            "AND user_id IN (SELECT user_id FROM entry)")


_n = "(SELECT count(DISTINCT user_id) FROM entry)"
_first = "('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003')"


def rate_sql():
    return f"""SELECT {_n} AS entry_users, count(DISTINCT user_id) AS repeat_users,
      {pct('count(DISTINCT user_id)', _n)} AS rate FROM repeats"""


O["r3_repurchase_rate"] = sql("scoped spairs", rate_sql(), entry=entry(), repeats=repeats())
O["r3_repurchase_rate_first"] = sql("scoped spairs", rate_sql(),
    entry=entry(f"influencer_name IN {_first}"), repeats=repeats(f"from_influencer IN {_first}"))
O["r3_repurchase_rate_rank"] = sql("scoped spairs", rate_sql(),
    entry="SELECT DISTINCT user_id FROM scoped WHERE purchase_rank = 1",
    repeats="SELECT * FROM spairs WHERE from_rank = 1 AND user_id IN (SELECT user_id FROM entry)")


def dest(column):
    return f"""SELECT {column}, count(*) AS n_moves, count(DISTINCT user_id) AS repeat_users,
      {rnd(pct('count(DISTINCT user_id)', _n), 2)} AS rate FROM repeats GROUP BY 1"""


O["r4_destinations"] = sql("scoped spairs", dest("to_influencer"), entry=entry(), repeats=repeats())
O["r4_destinations_sku"] = sql("scoped spairs", dest("to_sku"),
    entry=entry("sku IN ('Brand#1', 'Brand#2')"), repeats=repeats("from_sku IN ('Brand#1', 'Brand#2')"))
_monthly = f"""SELECT *, {rnd('rate - lag(rate) OVER (ORDER BY order_ym)', 2)} AS rate_change FROM (
  SELECT order_ym, count(*) AS entry_users, count(r.user_id) AS repeat_users,
    {rnd(pct('count(r.user_id)', 'count(*)'), 2)} AS rate
  FROM entry e LEFT JOIN (SELECT DISTINCT user_id FROM repeats) r USING (user_id) GROUP BY 1)"""
O["r5_monthly_rate"] = sql("scoped spairs", _monthly, entry=entry(), repeats=repeats())
_two = f"""count(*) AS n_moves, count(DISTINCT user_id) AS repeat_users,
  {rnd(pct('count(DISTINCT user_id)', _n), 2)} AS rate FROM repeats GROUP BY"""
O["r6_destinations_by_channel"] = sql("scoped spairs", f"""
  SELECT 'channel' AS level, to_channel_type, NULL::VARCHAR AS to_influencer, {_two} 2
  UNION ALL SELECT 'influencer', to_channel_type, to_influencer, {_two} 2, 3""", entry=entry(), repeats=repeats())
O["r7_interval_histogram"] = sql("scoped spairs", """
  SELECT least(floor((days_between - lo) * 30 / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)::BIGINT, 29) AS bin,
    count(*) AS n_pairs, min(days_between) AS min_days, max(days_between) AS max_days
  FROM d, (SELECT min(days_between) AS lo, max(days_between) AS hi FROM d) GROUP BY 1""",
    d="""SELECT days_between FROM spairs WHERE from_rank = 1
      AND user_id IN (SELECT user_id FROM scoped WHERE purchase_rank = 1)""")
_self = {"entry": entry("channel_type = 'self'"), "repeats": repeats("from_channel_type = 'self'")}
O["r8_channel_rate"] = sql("scoped spairs", rate_sql(), **_self)
O["r8_channel_monthly"] = sql("scoped spairs", _monthly, **_self)

# --- RFM ---------------------------------------------------------------------

_OK = "order_status IN ('completed', 'shipped')"


def ladder(x, steps, last):
    return "CASE " + " ".join(f"WHEN {x} <= {hi} THEN '{label}'" for label, hi in steps) + f" ELSE '{last}' END"


R_STEPS = (("0-30", 30), ("30-60", 60), ("60-90", 90), ("90-180", 180), ("180-365", 365))
C_STEPS = (("0-15", 15), ("15-45", 45), ("45-90", 90), ("90-180", 180), ("180-365", 365))
F_STEPS = (("1", 1), ("2", 2), ("3-5", 5), ("6-10", 10))
M_STEPS = (("0-50000", 50000), ("50000-200000", 200000), ("200000-500000", 500000),
           ("500000-1000000", 1000000))
R_LABELS = [s[0] for s in R_STEPS] + ["365+"]
C_LABELS = [s[0] for s in C_STEPS] + ["365+"]
F_LABELS = [s[0] for s in F_STEPS] + ["10+"]
M_LABELS = [s[0] for s in M_STEPS] + ["1000000+"]


def rfm(base="true", r_steps=R_STEPS, cut="TIMESTAMP '1999-12-31'", end="TIMESTAMP '2000-12-31'"):
    days = f"(epoch_us({cut}) - epoch_us(last_pay)) // {DAY}"
    return f"""SELECT b.user_id, last_pay, order_count, b.total AS total, {days} AS r_days,
      CASE WHEN r.user_id IS NOT NULL THEN 1 ELSE 0 END AS is_repurchase, coalesce(r.gmv, 0) AS repurchase,
      {ladder(days, r_steps, '365+')} AS r_bucket, {ladder('order_count', F_STEPS, '10+')} AS f_bucket,
      {ladder('b.total', M_STEPS, '1000000+')} AS m_bucket
    FROM (SELECT user_id, max(pay_time) AS last_pay, count(*) AS order_count, sum(gmv) AS total FROM labelled
      WHERE {_OK} AND gmv >= 20000 AND pay_time <= {cut} AND {base} GROUP BY 1) b
    LEFT JOIN (SELECT user_id, sum(gmv) AS gmv FROM scoped
      WHERE pay_time > {cut} AND pay_time <= {end} GROUP BY 1) r USING (user_id)"""


def dims(labels, dates=None):
    rows = ", ".join(f"({i}::BIGINT, '{l}', {repr(dates[i]) if dates else 'NULL'})" for i, l in enumerate(labels))
    return f"(VALUES {rows}) AS d(pos, bucket, date_range)"


def rfm_table(dim, labels, dates=None):
    body = f"""SELECT pos, d.bucket, date_range, count(u.user_id) AS base,
      coalesce(sum(is_repurchase), 0)::BIGINT AS repurchasers, {rnd('coalesce(sum(repurchase), 0)', 0)} AS amount
    FROM {dims(labels, dates)} LEFT JOIN u ON d.bucket = u.{dim}_bucket GROUP BY ALL"""
    date = "date_range, " if dates else ""
    dash = "'-', " if dates else ""
    rate = rnd(pct("repurchasers", "base"), 2)
    total_rate = rnd(pct("sum(repurchasers)", "sum(base)"), 2)
    return body, f"""SELECT pos, bucket, {date}base, repurchasers, amount, {rate} AS rate FROM t
    UNION ALL SELECT {len(labels)}::BIGINT, 'TTL', {dash}sum(base)::BIGINT, sum(repurchasers)::BIGINT, sum(amount), {total_rate} FROM t"""


def rfm_report(table, u):
    rows, body = table
    return sql("labelled scoped", body, u=u, t=rows)


_user_cols = """user_id, last_pay, order_count, total::DOUBLE AS total_gmv, r_days, is_repurchase::BIGINT AS is_repurchase,
  repurchase::DOUBLE AS repurchase_gmv, r_bucket, f_bucket, m_bucket"""
O["m1_windows"] = sql("labelled", f"""
  SELECT count(DISTINCT user_id) FILTER ({_OK} AND gmv >= 20000 AND pay_time <= TIMESTAMP '1999-12-31') AS base_users,
    count(DISTINCT user_id) FILTER (pay_time > TIMESTAMP '1999-12-31' AND pay_time <= TIMESTAMP '2000-12-31'
      AND order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS window_users FROM labelled""")
_m2 = "channel_type = 'self' AND category IN ('PROMO', 'SMALL')"
O["m2_base_scope"] = sql("labelled", f"""
  SELECT user_id, max(pay_time) AS last_pay, count(*) AS order_count, sum(gmv)::DOUBLE AS total_gmv FROM labelled
  WHERE {_OK} AND gmv >= 20000 AND pay_time <= TIMESTAMP '1999-12-31' AND {_m2} GROUP BY 1""")
O["m3_rfm_users"] = sql("labelled scoped", f"SELECT {_user_cols} FROM u", u=rfm())
O["m4_repurchase_flags"] = sql("labelled scoped", """
  SELECT is_repurchase::BIGINT AS is_repurchase, count(*) AS users, sum(repurchase)::DOUBLE AS gmv FROM u GROUP BY 1""",
    u=rfm("channel_type = 'self'"))
for _id, _dim in (("m5_recency_buckets", "r"), ("m6_frequency_buckets", "f"), ("m7_amount_buckets", "m")):
    O[_id] = sql("labelled scoped", f"SELECT {_dim}_bucket, count(*) AS users, min(r_days) AS min_days, "
                 f"max(order_count) AS max_orders FROM u GROUP BY 1", u=rfm())
O["m8_custom_recency"] = rfm_report(rfm_table("r", C_LABELS), u=rfm(r_steps=C_STEPS))
_dates = ["1999-12-02 ~ 1999-12-31", "1999-11-02 ~ 1999-12-01", "1999-10-03 ~ 1999-11-01",
          "1999-07-05 ~ 1999-10-02", "1999-01-01 ~ 1999-07-04", "<= 1998-12-31"]
O["m9_frequency_table"] = rfm_report(rfm_table("f", F_LABELS), u=rfm())
O["m9_amount_table"] = rfm_report(rfm_table("m", M_LABELS), u=rfm())
O["m10_recency_table_dated"] = rfm_report(rfm_table("r", R_LABELS, _dates), u=rfm())
O["m10_recency_inclusive_days"] = rfm_report(rfm_table("r", R_LABELS), u=rfm(
    cut="TIMESTAMP '1999-12-31 23:59:59.999999'", end="TIMESTAMP '2000-12-31 23:59:59.999999'"))
_cells = ", ".join(f"('{r}', '{f}')" for r in R_LABELS for f in F_LABELS)
_cross = f"""SELECT c.r_bucket, c.f_bucket, count(u.user_id) AS base, coalesce(sum(is_repurchase), 0)::BIGINT AS repurchasers,
    CASE WHEN count(u.user_id) > 0 THEN {rnd(pct('sum(is_repurchase)', 'count(u.user_id)'), 2)} END AS rate
  FROM (VALUES {_cells}) AS c(r_bucket, f_bucket)
  LEFT JOIN u ON u.r_bucket = c.r_bucket AND u.f_bucket = c.f_bucket GROUP BY 1, 2"""
O["m11_recency_frequency_cross"] = sql("labelled scoped", _cross, u=rfm())
O["m11_recency_frequency_matrix"] = sql("labelled scoped", "SELECT r_bucket, " + ", ".join(
    f"max(CASE WHEN f_bucket = '{f}' THEN rate END) AS f_{f.replace('-', '_').replace('+', '_up')}" for f in F_LABELS)
    + f" FROM ({_cross}) GROUP BY 1", u=rfm())
_export = f"SELECT * REPLACE ({rnd('total_gmv', 2)} AS total_gmv) FROM (SELECT {_user_cols} FROM u)"
O["m12_user_export_preview"] = sql("labelled scoped", _export + " ORDER BY user_id LIMIT 500", u=rfm())
O["m12_user_export"] = sql("labelled scoped", _export, u=rfm())

# --- flow --------------------------------------------------------------------

_early = "BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"
_links = f"""SELECT from_rank || '|' || from_influencer AS source, to_rank || '|' || to_influencer AS target,
  count(*) AS n_moves FROM pairs WHERE from_date {_early} AND from_channel_type = 'self' AND from_rank <= 5
    AND user_id IN (SELECT user_id FROM labelled WHERE order_date {_early} AND channel_type = 'self'
      AND after_sale_status = 'N')
  GROUP BY 1, 2 HAVING count(*) >= 2"""
_links_all = """SELECT from_rank || '|' || from_influencer AS source, to_rank || '|' || to_influencer AS target,
  count(*) AS n_moves FROM pairs WHERE from_rank <= 3 GROUP BY 1, 2 HAVING count(*) >= 3"""
_flow = f"""SELECT *, {rnd(pct('n_moves', 'source_total'), 1)} AS conversion
  FROM (SELECT *, (sum(n_moves) OVER (PARTITION BY source))::BIGINT AS source_total FROM links)"""
O["w1_flow_links"] = sql("pairs", _flow, links=_links)
O["w2_flow_conversion"] = sql("pairs", _flow, links=_links_all)
O["w3_flow_nodes"] = sql("pairs", """
  SELECT node, sum(n)::BIGINT AS out_flow FROM (SELECT source AS node, n_moves AS n FROM links
    UNION ALL SELECT target, 0 FROM links) GROUP BY 1""", links=_links_all)

# --- source trace ------------------------------------------------------------

O["o1_target_categories"] = sql("scoped", """
  SELECT category, count(DISTINCT user_id) AS n_users FROM scoped WHERE customer_type = 'returning' GROUP BY 1""")
O["o1_target_skus"] = sql("scoped", """
  SELECT sku, count(DISTINCT user_id) AS n_users FROM scoped WHERE category IN ('PROMO', 'SMALL') GROUP BY 1""")
_target = "category IN ('PROMO') AND sku IN ('Brand#1', 'Brand#2', 'Brand#3')"
_old_users = f"SELECT DISTINCT user_id FROM scoped WHERE customer_type = 'returning' AND {_target}"
_hist = "SELECT * FROM labelled WHERE order_date < DATE '2000-01-01' AND user_id IN (SELECT user_id FROM old)"
_trace = {"old": _old_users, "hist": _hist}
_kpi = f"""SELECT target_buyers, returning_users, with_history,
    {rnd(pct('returning_users', 'target_buyers'), 1)} AS returning_share,
    {rnd(pct('with_history', 'returning_users'), 1)} AS history_share
  FROM (SELECT (SELECT count(DISTINCT user_id) FROM scoped WHERE %s) AS target_buyers,
    (SELECT count(*) FROM old) AS returning_users,
    (SELECT count(DISTINCT user_id) FROM hist) AS with_history)"""
O["o2_target_users"] = sql("labelled scoped", _kpi % _target, **_trace)
O["o3_users_with_history"] = sql("labelled scoped", _kpi % "true",
    old="SELECT DISTINCT user_id FROM scoped WHERE customer_type = 'returning'", hist=_hist)


def history(keys, cond="true", extra=""):
    return f"""SELECT {keys}, count(DISTINCT user_id) AS n_users,
      {rnd(pct('count(DISTINCT user_id)', '(SELECT count(*) FROM old)'), 1)} AS share{extra}
      FROM hist WHERE {cond} GROUP BY {keys}"""


O["o4_history_by_channel"] = sql("labelled scoped", history("channel_type"), **_trace)
O["o5_history_by_influencer_top"] = sql("labelled scoped", history("channel_type, influencer_name")
    + " ORDER BY n_users DESC, channel_type, influencer_name LIMIT 25", **_trace)
O["o5_history_by_influencer"] = sql("labelled scoped", history("channel_type, influencer_name"), **_trace)
O["o6_history_by_category"] = sql("labelled scoped", history(
    "category", "channel_type = 'self'", ", category IN ('PROMO') AS is_target"), **_trace)

_chosen = ", ".join(f"'Supplier#00000000{i}'" for i in (1, 2, 3))
O["o6_history_of_source"] = sql("labelled scoped", f"""
  SELECT count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM old) AS target_users,
    {rnd(pct('count(DISTINCT user_id)', '(SELECT count(*) FROM old)'), 1)} AS share
  FROM hist WHERE channel_type = 'self' AND influencer_name IN ({_chosen})""", **_trace)
O["o6_influencers_on_offer"] = sql("labelled scoped", """
  SELECT channel_type, influencer_name, count(DISTINCT user_id) AS n_users FROM hist
  WHERE channel_type = 'self' GROUP BY 1, 2""", **_trace)

# --- discount ----------------------------------------------------------------

COUPON = r"'^(.+)-([\d,]+(?:\.\d+)?)$'"


def coupon_rows(src):
    return f"""SELECT sub_order_id AS order_key, (pos - 1)::BIGINT AS pos, trim(regexp_extract(piece, {COUPON}, 1)) AS coupon,
      CAST(replace(regexp_extract(piece, {COUPON}, 2), ',', '') AS DECIMAL(18,2)) AS amount
    FROM (SELECT sub_order_id, trim(p.piece) AS piece,
        row_number() OVER (PARTITION BY sub_order_id ORDER BY p.i) AS pos
      FROM (SELECT sub_order_id, unnest(string_split(platform_discount, ';')) AS piece,
        generate_subscripts(string_split(platform_discount, ';'), 1) AS i FROM {src}) p
      WHERE regexp_matches(trim(p.piece), {COUPON}))"""


_sel = "('PLAT-A', 'SHOP')"
_c = {"c": coupon_rows("scoped")}
_sub = {**_c, "s": f"""SELECT order_key, sum(amount) AS subsidy,
    string_agg(coupon || '(' || amount || ')', '; ' ORDER BY pos) AS coupon_text
  FROM c WHERE coupon IN {_sel} GROUP BY 1""",
    "d": """SELECT o.*, coalesce(subsidy, 0)::DECIMAL(18,2) AS subsidy, coalesce(coupon_text, '') AS coupon_text
  FROM scoped o LEFT JOIN s ON s.order_key = o.sub_order_id"""}
O["d1_parse_coupons"] = sql("scoped", "SELECT order_key, pos, coupon, amount::DOUBLE AS amount FROM c", **_c)
O["d2_coupon_stats"] = sql("scoped", f"""
  SELECT coupon, count(DISTINCT order_key) AS n_orders, {rnd('sum(amount)', 2)} AS amount,
    coupon IN {_sel} AS is_selected FROM c GROUP BY 1""", **_c)
O["d3_subsidy_per_order"] = sql("scoped", "SELECT order_key, subsidy::DOUBLE AS subsidy FROM s", **_sub)
O["d4_subsidy_totals"] = sql("scoped", f"""
  SELECT count(*) AS n_orders, count(*) FILTER (subsidy > 0) AS n_subsidised, {rnd('sum(gmv)', 2)} AS paid,
    {rnd('sum(subsidy)', 2)} AS subsidy, {rnd('sum(gmv) + sum(subsidy)', 2)} AS real_income,
    {rnd(pct('sum(subsidy)', 'sum(gmv)'), 2)} AS uplift_pct FROM d""", **_sub)
_monthly_flow = """SELECT order_ym, sum(gmv)::DOUBLE AS paid, sum(subsidy)::DOUBLE AS subsidy,
  (sum(gmv) + sum(subsidy))::DOUBLE AS real_income FROM d GROUP BY 1"""
O["d5_subsidy_monthly"] = sql("scoped", _monthly_flow, **_sub)
O["d5_subsidy_monthly_long"] = sql("scoped", " UNION ALL ".join(
    f"SELECT order_ym, '{f}' AS flow, {f} AS amount FROM m" for f in ("paid", "subsidy", "real_income")),
    **_sub, m=_monthly_flow)
O["d6_coupon_shares"] = sql("scoped", f"""
  SELECT coupon, count(DISTINCT order_key) AS n_orders, sum(amount)::DOUBLE AS amount,
    {pct('sum(amount)', f'(SELECT sum(amount) FROM c WHERE coupon IN {_sel})')} AS share
  FROM c WHERE coupon IN {_sel} GROUP BY 1""", **_c)
_detail = f"""SELECT sub_order_id AS order_key, pay_time, user_id, sku, influencer_name, channel_type, order_status,
  {rnd('gmv', 2)} AS paid, {rnd('subsidy', 2)} AS subsidy, {rnd('gmv + subsidy', 2)} AS real_income,
  coupon_text, platform_discount FROM d"""
O["d7_order_detail"] = sql("scoped", _detail + " WHERE subsidy > 0", **_sub)
O["d7_order_detail_preview"] = sql("scoped", _detail + " ORDER BY pay_time DESC, order_key LIMIT 500", **_sub)

# --- samples -----------------------------------------------------------------

_smp = "SELECT * FROM samples WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '2000-06-30'"
_known = f"""SELECT DISTINCT user_id FROM labelled WHERE {_OK} AND gmv >= 20000
  AND pay_time < TIMESTAMP '2000-01-01'"""
_b = {"smp": _smp, "known": _known, "b": """
  SELECT user_id, min(pay_time) AS sample_time, count(*) AS sample_orders,
    user_id NOT IN (SELECT user_id FROM known) AS is_new FROM smp GROUP BY 1""",
    "rep": "SELECT o.*, b.is_new, b.sample_time FROM scoped o JOIN b USING (user_id)",
    "rep_prev": "SELECT o.*, b.is_new FROM prev o JOIN b USING (user_id)"}
O["a1_sample_filter"] = sql("samples", """
  SELECT sample_type, sku, count(*) AS n_samples FROM samples WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '2000-06-30'
    AND order_status IN ('completed') AND sample_type IN ('PROMO', 'SMALL') GROUP BY 1, 2""")
O["a1_sample_choices"] = sql("samples", "SELECT DISTINCT sample_type, sku FROM smp", smp=_smp)
O["a2_first_samples"] = sql("samples", """
  SELECT user_id, min(pay_time) AS sample_time, count(*) AS sample_orders FROM smp GROUP BY 1""", smp=_smp)
O["a3_sample_repurchase"] = sql("labelled scoped prev samples", """
  SELECT user_id, count(*) AS repeat_orders, sum(gmv)::DOUBLE AS repeat_gmv FROM rep GROUP BY 1""", **_b)
O["a3_sample_repurchase_after"] = sql("labelled scoped prev samples", """
  SELECT user_id, count(*) AS repeat_orders, sum(gmv)::DOUBLE AS repeat_gmv FROM rep
  WHERE pay_time > sample_time GROUP BY 1""", **_b)
O["a4_new_sample_buyers"] = sql("labelled scoped prev samples", "SELECT user_id, is_new FROM b", **_b)


def _repeat(src, end):
    return f"""(SELECT count(DISTINCT user_id) FROM {src}) AS repeat_users{end},
      (SELECT count(DISTINCT user_id) FROM {src} WHERE is_new) AS repeat_new{end},
      (SELECT count(*) FROM {src}) AS repeat_orders{end},
      (SELECT coalesce(sum(gmv), 0)::DOUBLE FROM {src}) AS repeat_gmv{end}"""


_a5 = f"""SELECT *, {per('repeat_new', 'buyers')} AS acquisition_rate, {per('repeat_users', 'buyers')} AS repeat_rate,
    {per('repeat_new_prev', 'buyers')} AS acquisition_rate_prev, {per('repeat_users_prev', 'buyers')} AS repeat_rate_prev
  FROM (SELECT (SELECT count(*) FROM smp) AS sample_orders, (SELECT count(*) FROM b) AS buyers,
    (SELECT count(*) FROM b WHERE is_new) AS new_buyers, {_repeat('rep', '')}, {_repeat('rep_prev', '_prev')})"""
O["a5_sample_kpi"] = sql("labelled scoped prev samples", _a5, **_b)
O["a6_sample_kpi_delta"] = sql("labelled scoped prev samples", " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, {m}::DOUBLE AS current_value, {m}_prev::DOUBLE AS previous_value,
    {m}::DOUBLE - {m}_prev::DOUBLE AS delta FROM k""" for m in (
        "acquisition_rate", "repeat_users", "repeat_new", "repeat_orders", "repeat_rate", "repeat_gmv")), **_b, k=_a5)


def cohort(fmt):
    return f"""SELECT strftime(b.sample_time, '{fmt}') AS period, count(*) AS buyers, count(r.n) AS repeat_users,
      coalesce(sum(r.n), 0)::BIGINT AS repeat_orders, {rnd(pct('count(r.n)', 'count(*)'), 2)} AS rate
    FROM b LEFT JOIN (SELECT user_id, count(*) AS n FROM rep GROUP BY 1) r USING (user_id) GROUP BY 1"""


O["a7_sample_cohort_monthly"] = sql("labelled scoped prev samples", cohort("%Y-%m"), **_b)
O["a7_sample_cohort_daily"] = sql("labelled scoped prev samples", cohort("%Y-%m-%d"), **_b)
O["a8_repurchased_products"] = sql("labelled scoped prev samples", f"""
  SELECT sku, count(*) AS repeat_orders, count(DISTINCT user_id) AS repeat_users, {rnd('sum(gmv)', 0)} AS repeat_gmv
  FROM rep GROUP BY 1""", **_b)


def detail(level, key):
    return f"""SELECT '{level}' AS level, sample_type, {key} AS sku, sum(n)::BIGINT AS sample_orders, count(*) AS buyers,
      count(*) FILTER (is_new) AS new_buyers, count(orders) AS repeat_users,
      count(orders) FILTER (is_new) AS repeat_new, coalesce(sum(orders), 0)::BIGINT AS repeat_orders,
      {rnd('coalesce(sum(gmv), 0)', 0)} AS repeat_gmv
    FROM (SELECT sample_type, {key} AS sku, user_id, count(*) AS n FROM smp GROUP BY 1, 2, 3) m
    JOIN b USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS orders, sum(gmv) AS gmv FROM rep GROUP BY 1) r
      USING (user_id) GROUP BY 2, 3"""


_none = "NULL::VARCHAR"
O["a9_sample_detail"] = sql("labelled scoped prev samples", f"""
  SELECT *, {rnd(per('repeat_gmv', 'repeat_users'), 0)} AS gmv_per_repeat_user,
    {rnd(pct('repeat_users', 'buyers'), 2)} AS rate
  FROM ({detail('sku', 'sku').replace("sku AS sku, sum", "m.sku AS sku, sum")}
    UNION ALL {detail('subtotal', _none)})""", **_b)

# --- members and crowds ------------------------------------------------------

_orders = "SELECT user_id, count(*) AS orders, sum(gmv) AS gmv FROM scoped GROUP BY 1"
_kinds = """SELECT *, CASE WHEN join_time::DATE BETWEEN greatest(lo, hi - 365) AND hi THEN 'new' ELSE 'old' END AS member_type
  FROM members, (SELECT min(join_time)::DATE AS lo, max(join_time)::DATE AS hi FROM members)"""
_mb = {"o": _orders, "m": _kinds}
O["b1_member_kinds"] = sql("members", "SELECT user_id, join_time, member_type FROM m", m=_kinds)
O["b2_member_kpi"] = sql("scoped members", f"""
  SELECT count(*) AS members, count(*) FILTER (member_type = 'new') AS new_members,
    count(*) FILTER (member_type = 'old') AS old_members, count(orders) AS buying_members,
    {per('count(orders)', 'count(*)')} AS conversion FROM m LEFT JOIN o USING (user_id)""", **_mb)
O["b3_member_compare"] = sql("scoped members", f"""
  SELECT member_type, count(m.user_id) AS members, count(orders) AS buyers, coalesce(sum(orders), 0)::BIGINT AS orders,
    {rnd('coalesce(sum(gmv), 0)', 0)} AS gmv, {rnd(pct('count(orders)', 'count(m.user_id)'), 2)} AS conversion_pct,
    {or_zero(rnd(per('sum(gmv)', 'count(orders)'), 0), 'count(orders)')} AS per_buyer
  FROM (VALUES ('new'), ('old')) k(member_type) LEFT JOIN m USING (member_type)
    LEFT JOIN o ON o.user_id = m.user_id GROUP BY 1""", **_mb)
O["b4_member_joins"] = sql("members", """
  SELECT strftime(join_time, '%Y-%m') AS join_ym, count(DISTINCT user_id) AS joined FROM members GROUP BY 1""")
O["b5_member_vs_non"] = sql("scoped members", f"""
  SELECT is_member, count(DISTINCT user_id) AS buyers, count(*) AS orders, {rnd('sum(gmv)', 0)} AS gmv,
    {rnd(per('sum(gmv)', 'count(DISTINCT user_id)'), 0)} AS per_buyer,
    {rnd(per('count(*)', 'count(DISTINCT user_id)'), 2)} AS frequency
  FROM (SELECT *, user_id IN (SELECT user_id FROM members) AS is_member FROM scoped) GROUP BY 1""")
_in = "user_id IN (SELECT user_id FROM members)"
O["b6_member_share"] = sql("scoped members", f"""
  SELECT {pct('count(DISTINCT user_id) FILTER (is_member)', 'count(DISTINCT user_id)')} AS buyer_share,
    {pct('sum(gmv) FILTER (is_member)', 'sum(gmv)')} AS gmv_share
  FROM (SELECT *, {_in} AS is_member FROM scoped)""")
_two_crowds = "crowd_name IN ('BUILDING', 'NATION_3')"
O["u1_crowd_kpi"] = sql("scoped crowds", f"""
  SELECT count(*) AS users, count(orders) AS buyers, {pct('count(orders)', 'count(*)')} AS conversion_pct,
    coalesce(sum(gmv), 0)::DOUBLE AS gmv
  FROM (SELECT DISTINCT user_id FROM crowds WHERE {_two_crowds}) LEFT JOIN o USING (user_id)""", o=_orders)
O["u2_crowd_compare"] = sql("scoped crowds", f"""
  SELECT crowd_name, count(*) AS users, count(orders) AS buyers, {rnd(pct('count(orders)', 'count(*)'), 2)} AS conversion_pct,
    coalesce(sum(orders), 0)::BIGINT AS orders, {rnd('coalesce(sum(gmv), 0)', 0)} AS gmv,
    {or_zero(rnd(per('sum(gmv)', 'count(orders)'), 0), 'count(orders)')} AS per_buyer
  FROM crowds LEFT JOIN o USING (user_id) GROUP BY 1""", o=_orders)
for _name, _key in (("day", "order_date"), ("month", "order_ym")):
    O[f"u3_crowd_trend_{_name}"] = sql("scoped crowds", f"""
      SELECT {_key}, count(*) AS orders, count(DISTINCT user_id) AS buyers, sum(gmv)::DOUBLE AS gmv FROM scoped
      WHERE user_id IN (SELECT user_id FROM crowds WHERE {_two_crowds}) GROUP BY 1""")
O["u4_crowd_products"] = sql("scoped crowds", f"""
  SELECT sku, count(*) AS orders, count(DISTINCT user_id) AS buyers, {rnd('sum(gmv)', 0)} AS gmv FROM scoped
  WHERE user_id IN (SELECT user_id FROM crowds WHERE {_two_crowds}) GROUP BY 1""")


def oracle_sql() -> dict[str, str]:
    return dict(O)
