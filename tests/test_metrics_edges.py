"""Metric and rule edge cases (FIXTURES section 3, rows 17-25, 29)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderlens.functions.columns import minimum_group_orders
from orderlens.operators import findings, metrics as K
from tests.helpers import mart_rows


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_growth_uses_present_months_only(spark):
    # row 18
    m = mart_rows(spark, [dict(purchase_period="2018-01", total_sales=100),
                          dict(purchase_period="2018-03", total_sales=150)])
    r = one(K.latest_growth(m))
    assert r["latest_growth"] == pytest.approx(0.5) and r["previous_period"] == "2018-01"


def test_growth_null_cases(spark):
    # row 19
    assert one(K.latest_growth(mart_rows(spark, [dict()])))["latest_growth"] is None
    m = mart_rows(spark, [dict(purchase_period="2018-01", total_sales=0),
                          dict(purchase_period="2018-02", total_sales=10)])
    assert one(K.latest_growth(m))["latest_growth"] is None


def test_peak_ties_go_to_earliest(spark):
    # row 20
    m = mart_rows(spark, [dict(purchase_period="2018-05", total_sales=50),
                          dict(purchase_period="2018-02", total_sales=50),
                          dict(purchase_period="2018-03", total_sales=10)])
    assert one(K.peak_period(m))["peak_period"] == "2018-02"


def test_minimum_group_orders(spark):
    # row 21, plus half-to-even cases (30 orders -> 1.5 -> 2, 50 -> 2.5 -> 2)
    df = spark.createDataFrame([(n,) for n in (0, 10, 30, 50, 70, 2000)], "n long")
    got = {r["n"]: r["m"] for r in df.select("n", minimum_group_orders("n").alias("m")).collect()}
    assert got == {n: max(1, min(50, round(n * 0.05))) for n in got}


def test_zero_revenue_and_freight(spark):
    # row 22
    m = mart_rows(spark, [dict(total_sales=0, total_freight=0)])
    assert one(K.kpis(m))["freight_share"] == 0.0
    assert one(K.category_summary(m))["freight_share"] is None


def test_no_late_orders(spark):
    # row 23
    m = mart_rows(spark, [dict(is_late=0), dict(is_late=0)])
    assert one(K.late_delay(m))["average_late_delay"] == 0.0
    assert one(K.review_gap(m))["review_gap"] is None


def _metrics_row(spark, **over):
    base = dict(
        total_orders=100, late_orders=10, late_rate=0.10, on_time_rate=0.90, freight_share=0.15,
        average_review=4.0, top_category="a", top_category_share=0.3, top_state="SP", top_state_share=0.4,
        top_three_category_share=0.60, peak_period="2018-01", peak_revenue=10.0, latest_growth=0.0,
        customers=10, repeat_rate=0.10, average_late_delay=3.0, review_gap=0.25,
        highest_risk_state=None, highest_risk_state_late_rate=None, highest_risk_state_orders=None,
        highest_risk_category=None, highest_risk_category_late_rate=None, highest_risk_category_orders=None,
        highest_freight_category=None, highest_freight_category_share=None,
    )
    base.update(over)
    schema = ", ".join(
        f"{k} {'string' if k in ('top_category', 'top_state', 'peak_period', 'highest_risk_state', 'highest_risk_category', 'highest_freight_category') else ('bigint' if k in ('total_orders', 'late_orders', 'customers', 'highest_risk_state_orders', 'highest_risk_category_orders') else 'double')}"
        for k in base)
    return spark.createDataFrame([tuple(base.values())], schema)


def test_rule_boundaries_are_strict(spark):
    # row 24: every metric exactly on its boundary
    m = _metrics_row(spark)
    recs = {r["rule_id"]: r for r in findings.recommendations_from(m).collect()}
    assert recs["R1"]["severity"] == "success"
    assert recs["R2"]["severity"] == "info"
    assert recs["R3"]["severity"] == "success"
    assert "R8" not in recs and "R9" not in recs and "R12" not in recs
    assert recs["R10"]["severity"] == "success"
    assert recs["R11"]["severity"] == "success"
    status = {r["rule_id"]: r["severity"] for r in findings.business_status_from(m).collect()}
    assert status == {"G1": "success", "G2": "success", "G3": "success"}


def test_rules_fire_past_boundaries(spark):
    m = _metrics_row(spark, late_rate=0.11, freight_share=0.16, average_review=3.9, review_gap=0.26,
                     average_late_delay=3.1, repeat_rate=0.09, latest_growth=-0.01, top_three_category_share=0.61,
                     highest_risk_state="RJ", highest_risk_state_late_rate=0.2, highest_risk_state_orders=50)
    recs = {r["rule_id"]: r for r in findings.recommendations_from(m).collect()}
    assert [recs[k]["severity"] for k in ("R1", "R2", "R3", "R5", "R8", "R9", "R10", "R11", "R12")] == [
        "warning", "warning", "warning", "warning", "warning", "warning", "info", "warning", "info"]
    assert recs["R5"]["subject"] == "RJ" and recs["R5"]["metric_2"] == 50
    assert "11.0%" in recs["R1"]["text"]
    status = {r["rule_id"]: r["severity"] for r in findings.business_status_from(m).collect()}
    assert status == {"G1": "warning", "G2": "warning", "G3": "warning"}


def test_null_review(spark):
    # row 25: no R3 row, G2 warning
    m = _metrics_row(spark, average_review=None, review_gap=None)
    recs = {r["rule_id"] for r in findings.recommendations_from(m).collect()}
    assert "R3" not in recs and "R8" not in recs
    status = {r["rule_id"]: r["severity"] for r in findings.business_status_from(m).collect()}
    assert status["G2"] == "warning"
    ins = {r["rule_id"] for r in findings.insights_from(m).collect()}
    assert "I12" not in ins


def test_empty_view(spark):
    # row 29
    mart = mart_rows(spark, [dict(customer_state="SP", product_category="a")])
    view = K.filter_view(mart, "SP", "zzz")
    k = one(K.kpis(view))
    assert k["total_orders"] == 0 and k["late_rate"] is None and k["freight_share"] is None
    assert findings.recommendations(view).count() == 0
    assert findings.insights(view).count() == 0
    assert findings.business_status(view).count() == 0


def test_filters_apply_in_order(spark):
    mart = mart_rows(spark, [dict(customer_state="SP", product_category="a"),
                             dict(customer_state="RJ", product_category="b")])
    dom = K.filter_domains(mart, state="SP").where(F.col("domain") == "product_category").collect()
    assert [r["value"] for r in dom] == ["a"]
    assert K.filter_view(mart, "All", None).count() == 2


def test_repeat_rate_excludes_unknown_customers(spark):
    m = mart_rows(spark, [dict(customer_unique_id="u1"), dict(customer_unique_id="u1"),
                          dict(customer_unique_id="u2"), dict(customer_unique_id=None)])
    r = one(K.repeat_customers(m))
    assert (r["customers"], r["repeat_customers"], r["repeat_rate"]) == (2, 1, 0.5)


def test_eligible_arg_max_ties_prefer_revenue(spark):
    rows = [dict(customer_state="A", is_late=1, total_sales=10), dict(customer_state="A", is_late=0, total_sales=10),
            dict(customer_state="B", is_late=1, total_sales=50), dict(customer_state="B", is_late=0, total_sales=50)]
    r = one(K.risk_leaders(mart_rows(spark, rows)))
    assert r["highest_risk_state"] == "B"
