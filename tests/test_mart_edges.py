"""Order-mart edge cases (FIXTURES section 3, rows 1-16)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens.operators import mart as M
from orderlens.operators.quality import MartQualityError, TargetClassError, check_mart, duplicate_keys
from tests.helpers import order, raw_tables


def _mart(spark, orders, items, **kw):
    return {r["order_id"]: r for r in M.build_order_mart(raw_tables(spark, orders, items, **kw)).collect()}


def _item(oid, n=1, product="p1", seller="s1", price=10, freight=1):
    return (oid, n, product, seller, price, freight)


def test_keep_first_runs_before_status_filter(spark):
    # row 1: the first copy is canceled -> the order is gone even though a delivered copy follows
    m = _mart(spark, [order("o1", status="canceled"), order("o1"), order("o2")], [_item("o1"), _item("o2")])
    assert set(m) == {"o2"}


def test_unparseable_date_drops_order(spark):
    # row 2
    m = _mart(spark, [order("o1", delivered="not a date"), order("o2")], [_item("o1"), _item("o2")])
    assert set(m) == {"o2"}


def test_late_flag_compares_timestamps(spark):
    # rows 3, 4 and 5
    m = _mart(spark, [
        order("eq", delivered="2018-01-20 00:00:00", estimated="2018-01-20 00:00:00"),
        order("sec", delivered="2018-01-20 00:00:01", estimated="2018-01-20 00:00:00"),
        order("neg", purchase="2018-01-10 00:00:00", estimated="2018-01-08 12:00:00",
              delivered="2018-01-09 00:00:00"),
    ], [_item("eq"), _item("sec"), _item("neg")])
    assert (m["eq"]["is_late"], m["eq"]["delivery_status"]) == (0, "On Time")
    assert (m["sec"]["is_late"], m["sec"]["delivery_status"]) == (1, "Late")
    assert m["neg"]["estimated_delivery_days"] == pytest.approx(-1.5)
    assert m["neg"]["delivery_days"] == pytest.approx(-1.0)


def test_orders_without_items_vanish_missing_summaries_are_null(spark):
    # rows 6, 7
    m = _mart(spark, [order("o1"), order("o2")], [_item("o2")])
    assert set(m) == {"o2"}
    assert m["o2"]["total_payment_value"] is None and m["o2"]["average_review_score"] is None


def test_all_null_prices_sum_to_zero(spark):
    # row 8
    m = _mart(spark, [order("o1")], [_item("o1", price=None, freight=None)])
    assert m["o1"]["total_sales"] == Decimal("0.00") and m["o1"]["total_freight"] == 0
    assert m["o1"]["item_count"] == 1


def test_category_mode_rules(spark):
    # rows 9, 10, 11, 12
    products = [("pb", "b"), ("pa", "a"), ("pn", None), ("pz", "z"), ("pt", "t_pt")]
    translation = [("t_pt", "translated")]
    items = [
        _item("tie", 1, "pb"), _item("tie", 2, "pa"),
        _item("nul", 1, "pn"), _item("nul", 2, "pn"), _item("nul", 3, "pz"),
        _item("none", 1, "pn"),
        _item("tr", 1, "pt"), _item("untr", 1, "pz"),
    ]
    orders = [order(o) for o in ("tie", "nul", "none", "tr", "untr")]
    m = _mart(spark, orders, items, products=products, translation=translation)
    assert m["tie"]["product_category"] == "a"
    assert m["nul"]["product_category"] == "z"
    assert m["none"]["product_category"] == "Unknown"
    assert m["tr"]["product_category"] == "translated"
    assert m["untr"]["product_category"] == "z"


def test_whole_row_item_dedupe(spark):
    # row 13: exact duplicate -> one row; same keys, other price -> two rows
    items = [_item("o1", 1, price=10), _item("o1", 1, price=10), _item("o2", 1, price=10), _item("o2", 1, price=11)]
    m = _mart(spark, [order("o1"), order("o2")], items)
    assert (m["o1"]["item_count"], m["o1"]["total_sales"]) == (1, Decimal("10.00"))
    assert (m["o2"]["item_count"], m["o2"]["total_sales"]) == (2, Decimal("21.00"))


def test_review_mean_and_payments(spark):
    # row 14
    m = _mart(spark, [order("o1")], [_item("o1")], reviews=[("o1", 1), ("o1", 4)],
              payments=[("o1", 5), ("o1", 5), ("o1", 7)])
    assert m["o1"]["average_review_score"] == 2.5
    assert m["o1"]["total_payment_value"] == Decimal("12.0000")  # duplicate payment row counted once


def test_missing_customer_is_unknown(spark):
    # row 15
    m = _mart(spark, [order("o1", cust="ghost")], [_item("o1")], customers=[("c1", "u1", "SP")])
    assert m["o1"]["customer_state"] == "Unknown" and m["o1"]["customer_unique_id"] is None


def test_duplicate_dimension_key_detected(spark):
    # row 16: a dimension that skipped de-duplication fails DQ1
    raw = raw_tables(spark, [order("o1")], [_item("o1")], customers=[("c1", "u1", "SP"), ("c1", "u2", "RJ")])
    assert duplicate_keys(raw.customers, "customer_id").count() == 1
    assert duplicate_keys(M.customers_dim(raw), "customer_id").count() == 0


def test_keep_first_takes_file_order(spark):
    raw = raw_tables(spark, [order("o1")], [_item("o1")], customers=[("c1", "u1", "SP"), ("c1", "u2", "RJ")])
    assert M.customers_dim(raw).collect()[0]["customer_state"] == "SP"


def test_check_mart_requires_both_classes(spark):
    # row 17
    mart = M.build_order_mart(raw_tables(spark, [order("o1"), order("o2")], [_item("o1"), _item("o2")]))
    with pytest.raises(TargetClassError):
        check_mart(mart)
    dup = mart.unionByName(mart.withColumn("is_late", F.lit(1)))
    with pytest.raises(MartQualityError):
        check_mart(dup)


def test_seller_mode_and_null_keys(spark):
    items = [_item("o1", 1, seller="s1"), _item("o1", 2, seller="s2"), _item("o1", 3, seller="s2"),
             (None, 1, "p1", "s1", 5, 1)]
    m = _mart(spark, [order("o1")], items, sellers=[("s1", "AA"), ("s2", "BB")])
    assert m["o1"]["seller_state"] == "BB"
    assert m["o1"]["item_count"] == 3


def test_null_keys_match_null_key_dimension_row(spark):
    # pandas merge pairs a missing key with a missing key
    products = [("p1", "a"), (None, "nullcat")]
    m = _mart(spark, [order("o1")], [(("o1", 1, None, "s1", 10, 1))], products=products)
    assert m["o1"]["product_category"] == "nullcat"
    m2 = _mart(spark, [order("o1")], [(("o1", 1, None, "s1", 10, 1))], products=[("p1", "a")])
    assert m2["o1"]["product_category"] == "Unknown"


def test_hot_order_holding_a_third_of_items(spark):
    # one order carries a third of all item rows; results stay whole and exact
    hot = [("hot", i, "pa" if i % 3 else "pb", "s1", 1, 0.5) for i in range(3000)]
    rest = [(f"o{i}", 1, "pa", "s1", 2, 1) for i in range(6000)]
    orders = [order("hot")] + [order(f"o{i}") for i in range(0, 6000, 50)]
    m = _mart(spark, orders, hot + rest, products=[("pa", "a"), ("pb", "b")])
    assert m["hot"]["item_count"] == 3000
    assert m["hot"]["total_sales"] == Decimal("3000.00")
    assert m["hot"]["product_category"] == "a"
    assert len(m) == 1 + 120
