"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written against the driver's pre-registered views (orders, lineitem, customer,
...). ``_RAW`` maps the test tables onto the raw order tables, ``_MART`` builds
the order mart; each query appends its own CTEs and final SELECT. Floating
report metrics are rounded to 9 places, as the Spark side does.
"""

from __future__ import annotations

from orderlens.ml.bootstrap import poisson_limits
from orderlens.operators.findings import TEXT

_RAW_ONCE = """
raw_orders_once AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CASE WHEN o.o_orderstatus IN ('F', 'P') THEN 'delivered' ELSE 'canceled' END AS order_status,
         CAST(o.o_orderdate AS TIMESTAMP) + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS order_purchase_timestamp,
         CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
              ELSE CAST(o.o_orderdate AS TIMESTAMP)
                   + to_days(CAST(3 + (o.o_orderkey * 7919) % 28 + c.c_nationkey % 5 AS INTEGER))
                   + to_hours(CAST((o.o_orderkey * 31) % 24 AS INTEGER)) END AS order_delivered_customer_date,
         CAST(o.o_orderdate AS TIMESTAMP)
           + to_days(CAST(22 + 3 * CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS INTEGER)) AS order_estimated_delivery_date,
         o.o_orderkey AS pos
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
raw_customers_once AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id, CAST(c.c_custkey AS VARCHAR) AS customer_unique_id,
         n.n_name AS customer_state, c.c_custkey AS pos
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(l_tax AS DECIMAL(4,2)) + CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS freight_value
  FROM lineitem
),
raw_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS INTEGER) AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id, price, freight_value
  FROM (SELECT * FROM li UNION ALL SELECT * FROM li WHERE l_orderkey % 50 = 0)
),
raw_payments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(price + freight_value AS DECIMAL(18,4)) AS payment_value FROM li
),
raw_reviews AS (
  SELECT CAST((event_id * 3) // 4 AS VARCHAR) AS order_id,
         CAST(1 + CAST(floor(value) AS INTEGER) % 5 AS INTEGER) AS review_score
  FROM events
),
raw_products_once AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_brand END AS product_category_name, p_partkey AS pos
  FROM part
),
raw_translation AS (
  SELECT p_brand AS product_category_name, 'cat_' || substr(p_brand, 7) AS product_category_name_english,
         min(p_partkey) AS pos
  FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13') GROUP BY p_brand
),
raw_sellers_once AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS seller_id, n.n_name AS seller_state, s.s_suppkey AS pos
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

# Every so many keys a second, later row with other values, which keep-first drops.
_LATER_COPIES = """
raw_orders AS (
  SELECT * FROM raw_orders_once
  UNION ALL SELECT * REPLACE ('canceled' AS order_status, pos + 1000000000000 AS pos) FROM raw_orders_once WHERE pos % 61 = 0
),
raw_customers AS (
  SELECT * FROM raw_customers_once
  UNION ALL SELECT * REPLACE ('stale' AS customer_state, pos + 1000000000000 AS pos) FROM raw_customers_once WHERE pos % 53 = 0
),
raw_products AS (
  SELECT * FROM raw_products_once
  UNION ALL SELECT * REPLACE (CASE WHEN pos % 40 = 0 THEN NULL ELSE 'stale' END AS product_category_name, pos + 1000000000000 AS pos)
  FROM raw_products_once WHERE pos % 47 = 0
),
raw_sellers AS (
  SELECT * FROM raw_sellers_once
  UNION ALL SELECT * REPLACE ('stale' AS seller_state, pos + 1000000000000 AS pos) FROM raw_sellers_once WHERE pos % 7 = 0
)"""

_RAW = _RAW_ONCE + "," + _LATER_COPIES

_MART = """
orders_first AS (
  SELECT * EXCLUDE (pos) FROM raw_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY pos) = 1
),
delivered AS (
  SELECT * FROM orders_first
  WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL
    AND order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
),
customers_dim AS (
  SELECT customer_id, customer_unique_id, customer_state FROM raw_customers
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY pos) = 1
),
translation_dim AS (
  SELECT product_category_name, product_category_name_english FROM raw_translation
  QUALIFY row_number() OVER (PARTITION BY product_category_name ORDER BY pos) = 1
),
products_dim AS (
  SELECT p.product_id, coalesce(t.product_category_name_english, p.product_category_name) AS product_category
  FROM (SELECT * FROM raw_products QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY pos) = 1) p
  LEFT JOIN translation_dim t ON p.product_category_name IS NOT DISTINCT FROM t.product_category_name
),
sellers_dim AS (
  SELECT seller_id, seller_state FROM raw_sellers
  QUALIFY row_number() OVER (PARTITION BY seller_id ORDER BY pos) = 1
),
items_enriched AS (
  SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, i.freight_value,
         p.product_category, s.seller_state
  FROM (SELECT DISTINCT * FROM raw_items) i
  LEFT JOIN products_dim p ON i.product_id IS NOT DISTINCT FROM p.product_id
  LEFT JOIN sellers_dim s ON i.seller_id IS NOT DISTINCT FROM s.seller_id
),
cat_mode AS (
  SELECT order_id, product_category FROM (
    SELECT order_id, product_category, count(*) AS c FROM items_enriched
    WHERE order_id IS NOT NULL AND product_category IS NOT NULL GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY c DESC, product_category) = 1
),
seller_mode AS (
  SELECT order_id, seller_state FROM (
    SELECT order_id, seller_state, count(*) AS c FROM items_enriched
    WHERE order_id IS NOT NULL AND seller_state IS NOT NULL GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY c DESC, seller_state) = 1
),
item_totals AS (
  SELECT order_id, count(order_item_id) AS item_count,
         CAST(coalesce(sum(price), 0) AS DECIMAL(22,2)) AS total_sales,
         CAST(coalesce(sum(freight_value), 0) AS DECIMAL(28,4)) AS total_freight
  FROM items_enriched WHERE order_id IS NOT NULL GROUP BY 1
),
item_summary AS (
  SELECT t.order_id, t.item_count, t.total_sales, t.total_freight,
         coalesce(cm.product_category, 'Unknown') AS product_category,
         coalesce(sm.seller_state, 'Unknown') AS seller_state
  FROM item_totals t LEFT JOIN cat_mode cm USING (order_id) LEFT JOIN seller_mode sm USING (order_id)
),
payment_summary AS (
  SELECT order_id, CAST(coalesce(sum(payment_value), 0) AS DECIMAL(28,4)) AS total_payment_value
  FROM (SELECT DISTINCT * FROM raw_payments) WHERE order_id IS NOT NULL GROUP BY 1
),
review_summary AS (
  SELECT order_id, avg(review_score) AS average_review_score
  FROM (SELECT DISTINCT * FROM raw_reviews) WHERE order_id IS NOT NULL GROUP BY 1
),
mart AS (
  SELECT d.order_id, d.customer_id, d.order_status, d.order_purchase_timestamp,
         d.order_delivered_customer_date, d.order_estimated_delivery_date,
         c.customer_unique_id, coalesce(c.customer_state, 'Unknown') AS customer_state,
         s.item_count, s.total_sales, s.total_freight, s.product_category, s.seller_state,
         p.total_payment_value, r.average_review_score,
         CAST(month(d.order_purchase_timestamp) AS INTEGER) AS purchase_month,
         strftime(d.order_purchase_timestamp, '%Y-%m') AS purchase_period,
         (epoch_us(d.order_estimated_delivery_date) - epoch_us(d.order_purchase_timestamp)) / CAST(86400000000 AS DOUBLE) AS estimated_delivery_days,
         (epoch_us(d.order_delivered_customer_date) - epoch_us(d.order_purchase_timestamp)) / CAST(86400000000 AS DOUBLE) AS delivery_days,
         CAST(d.order_delivered_customer_date > d.order_estimated_delivery_date AS INTEGER) AS is_late,
         CASE WHEN d.order_delivered_customer_date > d.order_estimated_delivery_date THEN 'Late' ELSE 'On Time' END AS delivery_status
  FROM delivered d
  JOIN item_summary s USING (order_id)
  LEFT JOIN payment_summary p USING (order_id)
  LEFT JOIN review_summary r USING (order_id)
  LEFT JOIN customers_dim c ON d.customer_id IS NOT DISTINCT FROM c.customer_id
)"""

# Filter pair used by the *_filtered queries (values exist at every scale).
FILTER_STATE = "NATION_11"
FILTER_CATEGORY = "Brand#7"

_VIEW_ALL = "view AS (SELECT * FROM mart)"
_VIEW_FILTERED = (
    f"view AS (SELECT * FROM mart WHERE customer_state = '{FILTER_STATE}' "
    f"AND product_category = '{FILTER_CATEGORY}')"
)

_SUMMARIES = """
cat AS (
  SELECT product_category, CAST(sum(total_sales) AS DECIMAL(38,2)) AS revenue,
         CAST(sum(total_freight) AS DECIMAL(38,4)) AS freight, count(*) AS orders, avg(is_late) AS late_rate,
         CAST(sum(total_freight) AS DOUBLE) / nullif(CAST(sum(total_sales) AS DOUBLE) + CAST(sum(total_freight) AS DOUBLE), 0) AS freight_share
  FROM view GROUP BY 1
),
st AS (
  SELECT customer_state, CAST(sum(total_sales) AS DECIMAL(38,2)) AS revenue, count(*) AS orders,
         avg(is_late) AS late_rate, avg(delivery_days) AS average_delivery
  FROM view GROUP BY 1
),
mon AS (
  SELECT purchase_period, CAST(sum(total_sales) AS DECIMAL(38,2)) AS revenue FROM view GROUP BY 1
),
thr AS (
  SELECT CAST(greatest(1, least(50, round_even(CAST(count(*) AS DOUBLE) * 0.05, 0))) AS INTEGER) AS min_orders FROM view
),
el_st AS (SELECT * FROM st WHERE orders >= (SELECT min_orders FROM thr)),
el_cat AS (SELECT * FROM cat WHERE orders >= (SELECT min_orders FROM thr)),
k AS (
  SELECT CAST(sum(total_sales) AS DECIMAL(38,2)) AS total_revenue,
         CAST(sum(total_freight) AS DECIMAL(38,4)) AS total_freight,
         count(*) AS total_orders,
         CAST(coalesce(sum(is_late), 0) AS BIGINT) AS late_orders,
         CASE WHEN count(*) > 0 THEN CAST(sum(total_sales) AS DOUBLE) / count(*) END AS average_order_value,
         avg(delivery_days) AS average_delivery,
         avg(is_late) AS late_rate,
         1.0 - avg(is_late) AS on_time_rate,
         avg(average_review_score) AS average_review,
         CASE WHEN CAST(sum(total_sales) AS DOUBLE) + CAST(sum(total_freight) AS DOUBLE) > 0
              THEN CAST(sum(total_freight) AS DOUBLE) / (CAST(sum(total_sales) AS DOUBLE) + CAST(sum(total_freight) AS DOUBLE))
              WHEN sum(total_sales) IS NOT NULL THEN 0.0 END AS freight_share,
         (SELECT min_orders FROM thr) AS minimum_group_orders
  FROM view
),
conc AS (
  SELECT (SELECT product_category FROM cat ORDER BY revenue DESC, product_category LIMIT 1) AS top_category,
         (SELECT revenue FROM cat ORDER BY revenue DESC, product_category LIMIT 1) AS top_cat_rev,
         (SELECT customer_state FROM st ORDER BY revenue DESC, customer_state LIMIT 1) AS top_state,
         (SELECT revenue FROM st ORDER BY revenue DESC, customer_state LIMIT 1) AS top_state_rev,
         (SELECT sum(revenue) FROM (SELECT revenue FROM cat ORDER BY revenue DESC, product_category LIMIT 3)) AS top3_rev,
         (SELECT CAST(sum(total_sales) AS DOUBLE) FROM view) AS tot
),
conc2 AS (
  SELECT top_category,
         CASE WHEN tot > 0 THEN CAST(top_cat_rev AS DOUBLE) / tot WHEN tot IS NOT NULL THEN 0.0 END AS top_category_share,
         top_state,
         CASE WHEN tot > 0 THEN CAST(top_state_rev AS DOUBLE) / tot WHEN tot IS NOT NULL THEN 0.0 END AS top_state_share,
         CASE WHEN tot > 0 THEN CAST(top3_rev AS DOUBLE) / tot WHEN tot IS NOT NULL THEN 0.0 END AS top_three_category_share
  FROM conc
),
peak AS (
  SELECT purchase_period AS peak_period, revenue AS peak_revenue FROM mon ORDER BY revenue DESC, purchase_period LIMIT 1
),
last2 AS (SELECT * FROM mon ORDER BY purchase_period DESC LIMIT 2),
growth AS (
  SELECT max(purchase_period) AS latest_period,
         arg_max(revenue, purchase_period) AS latest_revenue,
         CASE WHEN count(*) = 2 THEN min(purchase_period) END AS previous_period,
         CASE WHEN count(*) = 2 THEN arg_min(revenue, purchase_period) END AS previous_revenue,
         CASE WHEN count(*) = 2 AND arg_min(revenue, purchase_period) > 0
              THEN CAST(arg_max(revenue, purchase_period) AS DOUBLE) / CAST(arg_min(revenue, purchase_period) AS DOUBLE) - 1.0 END AS latest_growth
  FROM last2
),
per_cust AS (
  SELECT customer_unique_id, count(*) AS n FROM view WHERE customer_unique_id IS NOT NULL GROUP BY 1
),
rep AS (
  SELECT count(*) AS customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
         CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE n > 1)) / count(*) ELSE 0.0 END AS repeat_rate
  FROM per_cust
),
delay AS (
  SELECT count(*) FILTER (WHERE is_late = 1) AS late_orders,
         coalesce(avg(CASE WHEN is_late = 1 THEN delivery_days - estimated_delivery_days END), 0.0) AS average_late_delay
  FROM view
),
gap AS (
  SELECT avg(CASE WHEN delivery_status = 'On Time' THEN average_review_score END) AS review_on_time,
         avg(CASE WHEN delivery_status = 'Late' THEN average_review_score END) AS review_late,
         avg(CASE WHEN delivery_status = 'On Time' THEN average_review_score END)
           - avg(CASE WHEN delivery_status = 'Late' THEN average_review_score END) AS review_gap
  FROM view
),
risk_s AS (SELECT * FROM el_st ORDER BY late_rate DESC, revenue DESC, customer_state LIMIT 1),
risk_c AS (SELECT * FROM el_cat ORDER BY late_rate DESC, revenue DESC, product_category LIMIT 1),
risk_f AS (
  SELECT * FROM el_cat WHERE freight_share IS NOT NULL
  ORDER BY freight_share DESC, revenue DESC, product_category LIMIT 1
),
risk AS (
  SELECT (SELECT customer_state FROM risk_s) AS highest_risk_state,
         (SELECT late_rate FROM risk_s) AS highest_risk_state_late_rate,
         (SELECT orders FROM risk_s) AS highest_risk_state_orders,
         (SELECT product_category FROM risk_c) AS highest_risk_category,
         (SELECT late_rate FROM risk_c) AS highest_risk_category_late_rate,
         (SELECT orders FROM risk_c) AS highest_risk_category_orders,
         (SELECT product_category FROM risk_f) AS highest_freight_category,
         (SELECT freight_share FROM risk_f) AS highest_freight_category_share
),
m AS (
  SELECT * FROM k, conc2, (SELECT peak_period, peak_revenue FROM peak RIGHT JOIN (SELECT 1) ON TRUE),
         (SELECT latest_growth FROM growth), (SELECT customers, repeat_rate FROM rep),
         (SELECT average_late_delay FROM delay), (SELECT review_gap FROM gap), risk
)"""


def _q(body: str, view: str = _VIEW_ALL, summaries: bool = True) -> str:
    parts = [_RAW, _MART, view] + ([_SUMMARIES] if summaries else [])
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body


def _r(x: str, alias: str | None = None) -> str:
    return f"round({x}, 9) AS {alias or x}"


_KPIS = (
    "SELECT total_revenue, total_freight, total_orders, late_orders, "
    + ", ".join(_r(c) for c in ["average_order_value", "average_delivery", "late_rate", "on_time_rate",
                               "average_review", "freight_share"])
    + ", minimum_group_orders FROM k"
)

_RULE_COLS = "rule_id, seq, severity, label, subject, metric_1, metric_2, metric_3"


def _rule(rule_id: str, seq: int, severity: str, label: str, where: str, subject: str = "NULL",
          m1: str = "NULL", m2: str = "NULL", m3: str = "NULL") -> str:
    return (
        f"SELECT '{rule_id}' AS rule_id, {seq} AS seq, {severity} AS severity, '{label}' AS label, "
        f"CAST({subject} AS VARCHAR) AS subject, round(CAST({m1} AS DOUBLE), 9) AS metric_1, "
        f"round(CAST({m2} AS DOUBLE), 9) AS metric_2, round(CAST({m3} AS DOUBLE), 9) AS metric_3 "
        f"FROM m WHERE total_orders > 0 AND ({where})"
    )


_RECOMMENDATIONS = "\nUNION ALL\n".join([
    _rule("R1", 1, "CASE WHEN late_rate > 0.10 THEN 'warning' ELSE 'success' END",
          "X", "TRUE", m1="late_rate").replace("'X' AS label",
                                               "CASE WHEN late_rate > 0.10 THEN 'High priority' ELSE 'Maintain' END AS label"),
    _rule("R2", 2, "CASE WHEN freight_share > 0.15 THEN 'warning' ELSE 'info' END", "Cost", "TRUE", m1="freight_share"),
    _rule("R3", 3, "CASE WHEN average_review < 4 THEN 'warning' ELSE 'success' END", "Customer experience",
          "average_review IS NOT NULL", m1="average_review"),
    _rule("R4", 4, "'info'", "Inventory", "TRUE", subject="top_category", m1="top_category_share"),
    _rule("R5", 5, "'warning'", "Geography", "highest_risk_state IS NOT NULL", subject="highest_risk_state",
          m1="highest_risk_state_late_rate", m2="highest_risk_state_orders"),
    _rule("R6", 6, "'warning'", "Seller operations", "highest_risk_category IS NOT NULL",
          subject="highest_risk_category", m1="highest_risk_category_late_rate", m2="highest_risk_category_orders"),
    _rule("R7", 7, "'info'", "Shipping efficiency", "highest_freight_category IS NOT NULL",
          subject="highest_freight_category", m1="highest_freight_category_share"),
    _rule("R8", 8, "'warning'", "Reviews", "review_gap IS NOT NULL AND review_gap > 0.25", m1="review_gap"),
    _rule("R9", 9, "'warning'", "Escalation", "average_late_delay > 3", m1="average_late_delay"),
    _rule("R10", 10, "CASE WHEN repeat_rate < 0.10 THEN 'info' ELSE 'success' END", "Retention", "TRUE",
          m1="repeat_rate"),
    _rule("R11", 11, "CASE WHEN latest_growth < 0 THEN 'warning' ELSE 'success' END", "Revenue trend",
          "latest_growth IS NOT NULL", m1="latest_growth"),
    _rule("R12", 12, "'info'", "Portfolio risk", "top_three_category_share > 0.60", m1="top_three_category_share"),
])

_INSIGHTS = "\nUNION ALL\n".join([
    _rule("I1", 1, "'info'", "Category leader", "TRUE", subject="top_category", m1="top_category_share"),
    _rule("I2", 2, "'info'", "Geographic leader", "TRUE", subject="top_state", m1="top_state_share"),
    _rule("I3", 3, "'info'", "Revenue concentration", "TRUE", m1="top_three_category_share"),
    _rule("I4", 4, "'info'", "Peak sales period", "TRUE", subject="peak_period", m1="peak_revenue"),
    _rule("I5", 5, "'info'", "Delivery outcome", "TRUE", m1="late_orders", m2="total_orders", m3="on_time_rate"),
    _rule("I6", 6, "'info'", "Customer retention", "TRUE", m1="repeat_rate", m2="customers"),
    _rule("I7", 7, "'info'", "Freight burden", "TRUE", m1="freight_share"),
    _rule("I8", 8, "'info'", "Late-order severity", "TRUE",
          subject="CASE WHEN late_orders > 0 THEN 'late' ELSE 'none' END",
          m1="CASE WHEN late_orders > 0 THEN average_late_delay END"),
    _rule("I9", 9, "'info'", "Latest monthly movement", "latest_growth IS NOT NULL",
          subject="CASE WHEN latest_growth >= 0 THEN 'increased' ELSE 'decreased' END", m1="abs(latest_growth)"),
    _rule("I10", 10, "'info'", "Highest-risk state", "highest_risk_state IS NOT NULL", subject="highest_risk_state",
          m1="highest_risk_state_late_rate", m2="highest_risk_state_orders"),
    _rule("I11", 11, "'info'", "Highest-risk category", "highest_risk_category IS NOT NULL",
          subject="highest_risk_category", m1="highest_risk_category_late_rate", m2="highest_risk_category_orders"),
    _rule("I12", 12, "'info'", "Delivery effect on reviews", "review_gap IS NOT NULL",
          subject="CASE WHEN review_gap >= 0 THEN 'higher' ELSE 'lower' END", m1="abs(review_gap)"),
    _rule("I13", 13, "'info'", "Highest freight burden", "highest_freight_category IS NOT NULL",
          subject="highest_freight_category", m1="highest_freight_category_share"),
])

_STATUS = "\nUNION ALL\n".join([
    _rule("G1", 1, "CASE WHEN coalesce(late_rate <= 0.10, FALSE) THEN 'success' ELSE 'warning' END", "Delivery",
          "TRUE", m1="late_rate"),
    _rule("G2", 2, "CASE WHEN coalesce(average_review IS NOT NULL AND average_review >= 4, FALSE) THEN 'success' ELSE 'warning' END",
          "Reviews", "TRUE", m1="average_review"),
    _rule("G3", 3, "CASE WHEN coalesce(freight_share <= 0.15, FALSE) THEN 'success' ELSE 'warning' END", "Freight",
          "TRUE", m1="freight_share"),
])

def _pct(x: str, digits: int = 1) -> str:
    return f"format('{{:.{digits}f}}%', ({x}) * 100)"


def _num(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {x})"


def _count(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def _money(x: str) -> str:
    return f"{_count(f'trunc({x})')} || '.' || right('0' || CAST(CAST(abs({x} - trunc({x})) * 100 AS INTEGER) AS VARCHAR), 2)"


def _text(kind: str, rule: str, seq: int, where: str, *cases: tuple[str, str, list[str]]) -> str:
    """One finding: ``cases`` are (condition, key of the text, its arguments)."""
    def one(key: str, args: list[str]) -> str:
        words = TEXT[key].replace("'", "''")
        return f"printf('{words}', {', '.join(args)})" if args else f"'{words}'"

    text = "CASE " + " ".join(f"WHEN {c} THEN {one(key, args)}" for c, key, args in cases) + " END"
    return f"SELECT '{kind}' AS kind, '{rule}' AS rule_id, {seq} AS seq, {text} AS text FROM m WHERE total_orders > 0 AND ({where})"


def _texts() -> str:
    late, fs, rev, g, gap = "late_rate", "freight_share", "average_review", "latest_growth", "review_gap"
    rec, ins, state = "recommendation", "insight", "status"
    return "\nUNION ALL\n".join([
        _text(rec, "R1", 1, "TRUE", (f"{late} > 0.10", "R1_warn", [_pct(late)]), ("TRUE", "R1_ok", [_pct(late)])),
        _text(rec, "R2", 2, "TRUE", (f"{fs} > 0.15", "R2_warn", [_pct(fs)]), ("TRUE", "R2_ok", [_pct(fs)])),
        _text(rec, "R3", 3, f"{rev} IS NOT NULL", (f"{rev} < 4", "R3_warn", [_num(rev, 2)]), ("TRUE", "R3_ok", [_num(rev, 2)])),
        _text(rec, "R4", 4, "TRUE", ("TRUE", "R4", ["top_category", _pct("top_category_share")])),
        _text(rec, "R5", 5, "highest_risk_state IS NOT NULL", ("TRUE", "R5", [
            "highest_risk_state", _pct("highest_risk_state_late_rate"), _count("highest_risk_state_orders")])),
        _text(rec, "R6", 6, "highest_risk_category IS NOT NULL", ("TRUE", "R6", [
            "highest_risk_category", _pct("highest_risk_category_late_rate")])),
        _text(rec, "R7", 7, "highest_freight_category IS NOT NULL", ("TRUE", "R7", [
            "highest_freight_category", _pct("highest_freight_category_share")])),
        _text(rec, "R8", 8, f"{gap} IS NOT NULL AND {gap} > 0.25", ("TRUE", "R8", [_num(gap, 2)])),
        _text(rec, "R9", 9, "average_late_delay > 3", ("TRUE", "R9", [_num("average_late_delay", 1)])),
        _text(rec, "R10", 10, "TRUE", ("repeat_rate < 0.10", "R10_low", [_pct("repeat_rate")]), ("TRUE", "R10_ok", [_pct("repeat_rate")])),
        _text(rec, "R11", 11, f"{g} IS NOT NULL", (f"{g} < 0", "R11_down", [_pct(f"abs({g})")]), ("TRUE", "R11_up", [_pct(g)])),
        _text(rec, "R12", 12, "top_three_category_share > 0.60", ("TRUE", "R12", [_pct("top_three_category_share")])),
        _text(ins, "I1", 1, "TRUE", ("TRUE", "I1", ["top_category", _pct("top_category_share")])),
        _text(ins, "I2", 2, "TRUE", ("TRUE", "I2", ["top_state", _pct("top_state_share")])),
        _text(ins, "I3", 3, "TRUE", ("TRUE", "I3", [_pct("top_three_category_share")])),
        _text(ins, "I4", 4, "TRUE", ("TRUE", "I4", ["peak_period", _money("peak_revenue")])),
        _text(ins, "I5", 5, "TRUE", ("TRUE", "I5", [_count("late_orders"), _count("total_orders"), _pct("on_time_rate")])),
        _text(ins, "I6", 6, "TRUE", ("TRUE", "I6", [_pct("repeat_rate"), _count("customers")])),
        _text(ins, "I7", 7, "TRUE", ("TRUE", "I7", [_pct(fs)])),
        _text(ins, "I8", 8, "TRUE", ("late_orders > 0", "I8_late", [_num("average_late_delay", 1)]), ("TRUE", "I8_none", [])),
        _text(ins, "I9", 9, f"{g} IS NOT NULL", ("TRUE", "I9", [
            f"CASE WHEN {g} >= 0 THEN 'increased' ELSE 'decreased' END", _pct(f"abs({g})")])),
        _text(ins, "I10", 10, "highest_risk_state IS NOT NULL", ("TRUE", "I10", [
            "highest_risk_state", _pct("highest_risk_state_late_rate"), _count("highest_risk_state_orders")])),
        _text(ins, "I11", 11, "highest_risk_category IS NOT NULL", ("TRUE", "I11", [
            "highest_risk_category", _pct("highest_risk_category_late_rate"), _count("highest_risk_category_orders")])),
        _text(ins, "I12", 12, f"{gap} IS NOT NULL", ("TRUE", "I12", [
            _num(f"abs({gap})", 2), f"CASE WHEN {gap} >= 0 THEN 'higher' ELSE 'lower' END"])),
        _text(ins, "I13", 13, "highest_freight_category IS NOT NULL", ("TRUE", "I13", [
            "highest_freight_category", _pct("highest_freight_category_share")])),
        _text(state, "G1", 1, "TRUE", (f"{late} <= 0.10", "G1_ok", []), ("TRUE", "G1_warn", [])),
        _text(state, "G2", 2, "TRUE", (f"{rev} IS NOT NULL AND {rev} >= 4", "G2_ok", []), ("TRUE", "G2_warn", [])),
        _text(state, "G3", 3, "TRUE", (f"{fs} <= 0.15", "G3_ok", []), ("TRUE", "G3_warn", [])),
    ])


_VIEW_NONE = "view AS (SELECT * FROM mart WHERE customer_state = 'no such state')"
_VIEW_WIDEST = """gaps AS (
  SELECT customer_state, avg(CASE WHEN delivery_status = 'On Time' THEN average_review_score END)
           - avg(CASE WHEN delivery_status = 'Late' THEN average_review_score END) AS gap
  FROM mart GROUP BY 1
),
view AS (SELECT * FROM mart WHERE customer_state = (
  SELECT customer_state FROM gaps WHERE gap IS NOT NULL ORDER BY gap DESC, customer_state LIMIT 1))"""

_SORTED = """
SELECT 'category_summary' AS output, row_number() OVER (ORDER BY revenue DESC, product_category) AS rank,
       product_category AS key, revenue FROM cat
UNION ALL SELECT 'state_summary', row_number() OVER (ORDER BY revenue DESC, customer_state), customer_state, revenue FROM st
UNION ALL SELECT 'monthly_revenue', row_number() OVER (ORDER BY purchase_period), purchase_period, NULL FROM mon
UNION ALL SELECT 'filter_domains', row_number() OVER (ORDER BY domain, value), domain || '=' || value, NULL FROM (
  SELECT DISTINCT 'customer_state' AS domain, customer_state AS value FROM mart
  UNION ALL SELECT DISTINCT 'product_category', product_category FROM mart
  UNION ALL SELECT DISTINCT 'model_product_category', product_category FROM mart
  UNION ALL SELECT DISTINCT 'seller_state', seller_state FROM mart)
"""

_NUMBER_FORMATS = (
    "SELECT order_id, "
    + ", ".join([
        _pct("CAST(item_count AS DOUBLE) / 16") + " AS share", _pct("CAST(item_count AS DOUBLE) / 80", 2) + " AS fine_share",
        _num("CAST(total_sales AS DOUBLE) / 8", 2) + " AS eighth", _num("-CAST(total_sales AS DOUBLE) / 4", 1) + " AS quarter",
        _num("delivery_days", 1) + " AS days",
        _count("round_even(CAST(total_sales AS DOUBLE) * 12.5, 0)") + " AS grouped",
        _num("CAST(item_count AS DOUBLE) * CAST(0.15 AS DOUBLE)", 1) + " AS binary",
        _count("floor(CAST(total_sales AS DOUBLE))") + " AS units", _money("total_sales") + " AS money"])
    + " FROM mart")

# The orders' timestamps as text, some of them no timestamps.
_TEXT_ORDERS = """
text_orders AS (
  SELECT order_id, customer_id, order_status, pos,
         CASE CAST(order_id AS BIGINT) % 8
              WHEN 2 THEN strftime(order_purchase_timestamp, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN 'not a date' WHEN 4 THEN ''
              WHEN 5 THEN '2018-13-45 00:00:00' WHEN 6 THEN strftime(order_purchase_timestamp, '%Y-%m-%d')
              ELSE strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') || '.250000' END AS purchase,
         CASE WHEN CAST(order_id AS BIGINT) % 9 = 1 THEN 'unknown'
              ELSE strftime(order_delivered_customer_date, '%Y-%m-%d %H:%M:%S') END AS delivery,
         strftime(order_estimated_delivery_date, '%Y-%m-%d %H:%M:%S') AS estimate
  FROM raw_orders
),
text_first AS (
  SELECT order_id, customer_id, order_status, TRY_CAST(purchase AS TIMESTAMP) AS order_purchase_timestamp,
         TRY_CAST(delivery AS TIMESTAMP) AS order_delivered_customer_date, TRY_CAST(estimate AS TIMESTAMP) AS order_estimated_delivery_date
  FROM text_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY pos) = 1
)"""

_DQ = """
SELECT 'DQ1' AS check_id, 'translation.product_category_name' AS subject,
       (SELECT count(*) FROM (SELECT product_category_name FROM raw_translation GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'DQ1', 'orders.order_id', (SELECT count(*) FROM (SELECT order_id FROM raw_orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'products.product_id', (SELECT count(*) FROM (SELECT product_id FROM raw_products GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'sellers.seller_id', (SELECT count(*) FROM (SELECT seller_id FROM raw_sellers GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'customers.customer_id', (SELECT count(*) FROM (SELECT customer_id FROM raw_customers GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'items.row', (SELECT count(*) FROM (SELECT order_id FROM raw_items GROUP BY order_id, order_item_id, product_id, seller_id, price, freight_value HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'payments.row', (SELECT count(*) FROM (SELECT order_id FROM raw_payments GROUP BY order_id, payment_value HAVING count(*) > 1))
UNION ALL SELECT 'DQ1', 'reviews.row', (SELECT count(*) FROM (SELECT order_id FROM raw_reviews GROUP BY order_id, review_score HAVING count(*) > 1))
UNION ALL SELECT 'DQ2', 'mart.order_id', (SELECT count(*) FROM (SELECT order_id FROM mart GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'DQ3', 'mart.is_late', (SELECT 2 - count(DISTINCT is_late) FROM mart)
"""


def oracle_queries() -> dict[str, str]:
    q = {
        "order_mart": _q("SELECT * FROM mart", summaries=False),
        "delivered_orders": _q("SELECT * FROM delivered", summaries=False),
        "product_dim_translated": _q("SELECT * FROM products_dim", summaries=False),
        "items_enriched": _q("SELECT * FROM items_enriched", summaries=False),
        "item_summary": _q("SELECT * FROM item_summary", summaries=False),
        "payment_summary": _q("SELECT * FROM payment_summary", summaries=False),
        "review_summary": _q("SELECT * FROM review_summary", summaries=False),
        "kpis": _q(_KPIS),
        "kpis_filtered": _q(_KPIS, view=_VIEW_FILTERED),
        "category_summary": _q(
            "SELECT product_category, revenue, freight, orders, round(late_rate, 9) AS late_rate, "
            "round(freight_share, 9) AS freight_share FROM cat"),
        "state_summary": _q(
            "SELECT customer_state, revenue, orders, round(late_rate, 9) AS late_rate, "
            "round(average_delivery, 9) AS average_delivery FROM st"),
        "monthly_revenue": _q("SELECT purchase_period, revenue FROM mon"),
        "late_rate_by_state_eligible": _q(
            "SELECT customer_state, revenue, orders, round(late_rate, 9) AS late_rate, "
            "round(average_delivery, 9) AS average_delivery FROM el_st "
            "ORDER BY late_rate DESC, revenue DESC, customer_state LIMIT 10"),
        "category_eligible": _q(
            "SELECT product_category, revenue, freight, orders, round(late_rate, 9) AS late_rate, "
            "round(freight_share, 9) AS freight_share FROM el_cat"),
        "top_categories": _q(
            "SELECT product_category, revenue, freight, orders, round(late_rate, 9) AS late_rate, "
            "round(freight_share, 9) AS freight_share FROM cat ORDER BY revenue DESC, product_category LIMIT 10"),
        "top_states": _q(
            "SELECT customer_state, revenue, orders, round(late_rate, 9) AS late_rate, "
            "round(average_delivery, 9) AS average_delivery FROM st ORDER BY revenue DESC, customer_state LIMIT 10"),
        "concentration": _q(
            "SELECT top_category, round(top_category_share, 9) AS top_category_share, top_state, "
            "round(top_state_share, 9) AS top_state_share, "
            "round(top_three_category_share, 9) AS top_three_category_share FROM conc2"),
        "peak_period": _q("SELECT peak_period, peak_revenue FROM peak"),
        "latest_growth": _q(
            "SELECT latest_period, latest_revenue, previous_period, previous_revenue, "
            "round(latest_growth, 9) AS latest_growth FROM growth"),
        "repeat_customers": _q("SELECT customers, repeat_customers, round(repeat_rate, 9) AS repeat_rate FROM rep"),
        "late_delay": _q("SELECT late_orders, round(average_late_delay, 9) AS average_late_delay FROM delay"),
        "review_gap": _q(
            "SELECT round(review_on_time, 9) AS review_on_time, round(review_late, 9) AS review_late, "
            "round(review_gap, 9) AS review_gap FROM gap"),
        "review_by_status": _q(
            "SELECT delivery_status, round(avg(average_review_score), 9) AS average_review FROM view GROUP BY 1"),
        "risk_leaders": _q(
            "SELECT highest_risk_state, round(highest_risk_state_late_rate, 9) AS highest_risk_state_late_rate, "
            "highest_risk_state_orders, highest_risk_category, "
            "round(highest_risk_category_late_rate, 9) AS highest_risk_category_late_rate, "
            "highest_risk_category_orders, highest_freight_category, "
            "round(highest_freight_category_share, 9) AS highest_freight_category_share FROM risk"),
        "filter_domains": _q(
            "SELECT * FROM (SELECT DISTINCT 'customer_state' AS domain, customer_state AS value FROM mart "
            "UNION ALL SELECT DISTINCT 'product_category', product_category FROM mart "
            "UNION ALL SELECT DISTINCT 'model_product_category', product_category FROM mart "
            "UNION ALL SELECT DISTINCT 'seller_state', seller_state FROM mart) ORDER BY domain, value",
            summaries=False),
        "feature_defaults": _q(
            "SELECT count(*) AS orders, round(median(CAST(total_sales AS DOUBLE)), 9) AS median_total_sales, "
            "round(median(CAST(total_freight AS DOUBLE)), 9) AS median_total_freight, "
            "round_even(median(estimated_delivery_days), 1) AS median_estimated_delivery_days FROM mart",
            summaries=False),
        "preview": _q("SELECT * FROM view ORDER BY order_id LIMIT 100", summaries=False),
        "recommendations": _q(_RECOMMENDATIONS),
        "insights": _q(_INSIGHTS),
        "business_status": _q(_STATUS),
        "recommendations_filtered": _q(_RECOMMENDATIONS, view=_VIEW_FILTERED),
        "finding_texts": _q(_texts()),
        "finding_texts_filtered": _q(_texts(), view=_VIEW_FILTERED),
        "number_formats": _q(_NUMBER_FORMATS, summaries=False),
        "sorted_outputs": _q(_SORTED),
        "kpis_no_match": _q(_KPIS, view=_VIEW_NONE),
        "findings_no_match": _q(_texts(), view=_VIEW_NONE),
        "recommendations_widest_gap": _q(_RECOMMENDATIONS, view=_VIEW_WIDEST),
        "delivered_orders_text": "WITH " + _RAW.strip() + "," + _TEXT_ORDERS + """
SELECT * FROM text_first WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL
  AND order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL""",
        "dq_violations": _q(_DQ, summaries=False),
    }
    q.update(ml_oracle_queries())
    return q


_SPLIT = """
sp AS (
  SELECT order_id, is_late, customer_state,
         CAST('0x' || substr(md5('42:' || order_id), 1, 15) AS BIGINT) AS h
  FROM mart
),
sp2 AS (
  SELECT *, row_number() OVER (PARTITION BY is_late ORDER BY h, order_id) AS rn,
         count(*) OVER (PARTITION BY is_late) AS nc
  FROM sp
),
split AS (
  SELECT order_id, is_late, customer_state,
         CASE WHEN rn <= nc - (nc + 4) // 5 THEN 'train' ELSE 'test' END AS split
  FROM sp2
),
prior AS (SELECT customer_state, avg(is_late) AS state_rate FROM split WHERE split = 'train' GROUP BY 1),
base AS (SELECT avg(is_late) AS b FROM split WHERE split = 'train'),
pred AS (
  SELECT t.order_id, t.is_late AS label,
         CAST(coalesce(p.state_rate, (SELECT b FROM base)) > (SELECT b FROM base) AS INTEGER) AS prediction,
         coalesce(p.state_rate, (SELECT b FROM base)) AS score
  FROM split t LEFT JOIN prior p USING (customer_state) WHERE t.split = 'test'
),
cm AS (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
  FROM pred
),
ps AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM pred GROUP BY 1
),
ps2 AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM ps
),
auc AS (
  SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + CAST(neg AS DOUBLE) * 0.5))
                   / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc
  FROM ps2
),
rates AS (
  SELECT tp, fp, fn, tn, tp + fp + fn + tn AS n,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
         CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
         CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0.0 END AS f0,
         tp + fn AS s1, tn + fp AS s0
  FROM cm
)"""


def _qs(body: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in [_RAW, _MART, _SPLIT]) + "\n" + body


def _median_row(c: str) -> str:
    return (f"SELECT '{c}' AS feature, 'median' AS kind, round(median(CAST({c} AS DOUBLE)), 9) AS median_value, "
            f"CAST(NULL AS VARCHAR) AS mode_value FROM tr")


def _mode_row(c: str) -> str:
    return (f"SELECT '{c}' AS feature, 'mode' AS kind, CAST(NULL AS DOUBLE) AS median_value, "
            f"(SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_value")


def _ratio(x: str) -> str:
    return f"round(CASE WHEN n > 0 THEN {x} ELSE 0.0 END, 9)"


def ml_oracle_queries() -> dict[str, str]:
    num = ["total_sales", "total_freight", "item_count", "estimated_delivery_days", "purchase_month"]
    cat = ["product_category", "customer_state", "seller_state"]
    tr = "tr AS (SELECT m.* FROM mart m JOIN split s USING (order_id) WHERE s.split = 'train')"
    limits = poisson_limits()
    copies = " + ".join(f"CAST(h >= {x} AS INTEGER)" for x in limits)
    requests = (
        "req AS (SELECT order_id, CAST(total_sales AS DOUBLE) AS total_sales, CAST(total_freight AS DOUBLE) AS total_freight, "
        "CASE WHEN d != 6 THEN CAST(item_count AS DOUBLE) END AS item_count, estimated_delivery_days, "
        "CAST(purchase_month AS DOUBLE) AS purchase_month, CASE WHEN d = 7 THEN 'never seen' ELSE product_category END AS product_category, "
        "customer_state, CASE WHEN d != 8 THEN seller_state END AS seller_state "
        "FROM (SELECT *, CAST(order_id AS BIGINT) % 10 AS d FROM mart))")
    slots = "\nUNION ALL\n".join(
        [f"SELECT order_id, '{c}' AS slot, round(coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM tr)), 9) AS value FROM req "
         f"WHERE coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM tr)) != 0" for c in num]
        + [f"SELECT order_id, '{c}=' || v, 1.0 FROM (SELECT order_id, coalesce({c}, (SELECT {c} FROM tr WHERE {c} IS NOT NULL "
           f"GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)) AS v FROM req) WHERE v IN (SELECT {c} FROM tr)" for c in cat])
    return {
        "encoded_features": "WITH " + ",\n".join(p.strip() for p in [_RAW, _MART, _SPLIT, tr, requests]) + "\n" + slots,
        "tree_weights": _qs(
            f"SELECT order_id, tree, copies, round(copies * CAST(sum(copies) OVER (PARTITION BY tree) AS DOUBLE) "
            f"/ (2.0 * sum(copies) OVER (PARTITION BY tree, is_late)), 9) AS weight "
            f"FROM (SELECT order_id, is_late, tree, {copies} AS copies FROM (SELECT order_id, is_late, tree, "
            f"CAST('0x' || substr(md5('42:' || tree || ':' || order_id), 1, 15) AS BIGINT) AS h "
            f"FROM split, (SELECT unnest([0, 1, 2]) AS tree) WHERE split = 'train')) WHERE copies > 0"),
        "training_profile": _q(
            "SELECT count(*) AS orders, CAST(coalesce(sum(is_late), 0) AS BIGINT) AS late_orders, "
            "round(avg(is_late), 9) AS late_rate FROM mart", summaries=False),
        "late_model_checks": _qs(
            "SELECT order_id, is_late AS label, TRUE AS probability_in_range, TRUE AS class_follows_probability "
            "FROM split WHERE split = 'test'"),
        "scored_orders_checks": _q(
            "SELECT order_id, TRUE AS probability_in_range, TRUE AS verdict_follows_class, TRUE AS shown_follows_verdict "
            "FROM mart WHERE total_sales >= 0 AND total_freight >= 0 AND item_count >= 1 "
            "AND estimated_delivery_days >= 1 AND purchase_month BETWEEN 1 AND 12", summaries=False),
        "scored_by_nodes": _q(
            "SELECT order_id, TRUE AS probability_agrees, TRUE AS verdict_agrees "
            "FROM mart WHERE total_sales >= 0 AND total_freight >= 0 AND item_count >= 1 "
            "AND estimated_delivery_days >= 1 AND purchase_month BETWEEN 1 AND 12", summaries=False),
        "scoring_rejects": _q(
            "SELECT * FROM (SELECT order_id, CASE "
            "WHEN CASE WHEN d = 1 THEN -total_sales ELSE total_sales END < 0 THEN 'total_sales must be >= 0' "
            "WHEN d = 5 OR total_freight < 0 THEN 'total_freight must be >= 0' "
            "WHEN d = 2 OR item_count < 1 THEN 'item_count must be >= 1' "
            "WHEN d = 4 OR estimated_delivery_days < 1 THEN 'estimated_delivery_days must be >= 1' "
            "WHEN d = 3 OR purchase_month NOT BETWEEN 1 AND 12 THEN 'purchase_month must be 1..12' END AS reject_reason "
            "FROM (SELECT *, CAST(order_id AS BIGINT) % 10 AS d FROM mart)) WHERE reject_reason IS NOT NULL",
            summaries=False),
        "split_counts": _qs("SELECT is_late, split, count(*) AS orders FROM split GROUP BY 1, 2"),
        "split_assignment": _qs("SELECT order_id, is_late, split FROM split"),
        "feature_imputation": "WITH " + ",\n".join(p.strip() for p in [_RAW, _MART, _SPLIT, tr]) + "\n"
        + "\nUNION ALL\n".join([_median_row(c) for c in num] + [_mode_row(c) for c in cat]),
        "eval_metrics": _qs(
            "SELECT n AS test_orders, " + _ratio("(tp + tn) / n") + " AS accuracy, round(p1, 9) AS precision, "
            "round(r1, 9) AS recall, round(f1, 9) AS f1, round((SELECT roc_auc FROM auc), 9) AS roc_auc FROM rates"),
        "confusion_matrix": _qs(
            "SELECT 0 AS label, tn AS pred_0, fp AS pred_1 FROM cm UNION ALL SELECT 1, fn, tp FROM cm"),
        "class_report": _qs(
            "SELECT 'On Time' AS class, round(p0, 9) AS precision, round(r0, 9) AS recall, round(f0, 9) AS f1_score, s0 AS support FROM rates "
            "UNION ALL SELECT 'Late', round(p1, 9), round(r1, 9), round(f1, 9), s1 FROM rates "
            "UNION ALL SELECT 'accuracy', NULL, NULL, " + _ratio("(tp + tn) / n") + ", n FROM rates "
            "UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 9), round((r0 + r1) / 2, 9), round((f0 + f1) / 2, 9), n FROM rates "
            "UNION ALL SELECT 'weighted avg', " + _ratio("(p0 * s0 + p1 * s1) / n") + ", "
            + _ratio("(r0 * s0 + r1 * s1) / n") + ", " + _ratio("(f0 * s0 + f1 * s1) / n") + ", n FROM rates"),
    }
