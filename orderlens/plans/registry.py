"""Named queries ``(spark, sf_dir) -> DataFrame`` over the driver's test tables.

Mart-level queries share one materialised mart per (application, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import findings, metrics as K
from orderlens.operators import mart as M
from orderlens.operators.quality import dq_violations
from orderlens.plans.dashboard import fixture_mart, fixture_raw
from orderlens.plans.ml_queries import ml_queries
from orderlens.sources.fixture import with_text_timestamps

Query = Callable[[SparkSession, str], DataFrame]

# Filter pair for the *_filtered queries (a state and a category present at every scale).
FILTER_STATE = "NATION_11"
FILTER_CATEGORY = "Brand#7"
# A state that no order has.
NO_STATE = "no such state"


def _raw_query(fn: Callable) -> Query:
    return lambda spark, sf_dir: fn(fixture_raw(spark, sf_dir))


def _view_query(fn: Callable[[DataFrame], DataFrame], filtered: bool = False, rounded: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mart = fixture_mart(spark, sf_dir)
        view = K.filter_view(mart, FILTER_STATE, FILTER_CATEGORY) if filtered else mart
        out = fn(view)
        return K.present(out) if rounded else out

    return run


def _findings(fn: Callable[..., DataFrame], filtered: bool = False) -> Query:
    return _view_query(lambda v: fn(v, with_text=False), filtered=filtered)


def dashboard_queries() -> dict[str, Query]:
    return {
        "order_mart": _view_query(lambda m: m, rounded=False),
        "delivered_orders": _raw_query(M.delivered_orders),
        "product_dim_translated": _raw_query(M.product_dim_translated),
        "items_enriched": _raw_query(M.items_enriched),
        "item_summary": _raw_query(M.item_summary),
        "payment_summary": _raw_query(M.payment_summary),
        "review_summary": _raw_query(M.review_summary),
        "kpis": _view_query(K.kpis),
        "kpis_filtered": _view_query(K.kpis, filtered=True),
        "category_summary": _view_query(lambda v: K.category_summary(v).orderBy(F.desc("revenue"), "product_category")),
        "state_summary": _view_query(lambda v: K.state_summary(v).orderBy(F.desc("revenue"), "customer_state")),
        "monthly_revenue": _view_query(lambda v: K.monthly_revenue(v).orderBy("purchase_period")),
        "late_rate_by_state_eligible": _view_query(K.late_rate_by_state_eligible),
        "category_eligible": _view_query(K.category_eligible),
        "top_categories": _view_query(K.top_categories),
        "top_states": _view_query(K.top_states),
        "concentration": _view_query(K.concentration),
        "peak_period": _view_query(K.peak_period),
        "latest_growth": _view_query(K.latest_growth),
        "repeat_customers": _view_query(K.repeat_customers),
        "late_delay": _view_query(K.late_delay),
        "review_gap": _view_query(K.review_gap),
        "review_by_status": _view_query(K.review_by_status),
        "risk_leaders": _view_query(K.risk_leaders),
        "filter_domains": lambda spark, sf_dir: K.filter_domains(fixture_mart(spark, sf_dir)),
        "feature_defaults": _view_query(K.feature_defaults),
        "preview": _view_query(K.preview, rounded=False),
        "recommendations": _findings(findings.recommendations),
        "insights": _findings(findings.insights),
        "business_status": _findings(findings.business_status),
        "recommendations_filtered": _findings(findings.recommendations, filtered=True),
        "finding_texts": _view_query(findings.finding_texts, rounded=False),
        "finding_texts_filtered": _view_query(findings.finding_texts, filtered=True, rounded=False),
        "number_formats": _view_query(K.number_formats, rounded=False),
        "sorted_outputs": _view_query(K.sorted_outputs, rounded=False),
        "kpis_no_match": _view_query(lambda v: K.kpis(K.filter_view(v, NO_STATE))),
        "findings_no_match": _view_query(lambda v: findings.finding_texts(K.filter_view(v, NO_STATE)), rounded=False),
        "recommendations_widest_gap": _view_query(
            lambda v: findings.recommendations(K.widest_review_gap_view(v), with_text=False)),
        "delivered_orders_text": lambda spark, sf_dir: M.delivered_orders(with_text_timestamps(fixture_raw(spark, sf_dir))),
        "dq_violations": lambda spark, sf_dir: dq_violations(fixture_raw(spark, sf_dir), fixture_mart(spark, sf_dir)),
    }


def all_queries() -> dict[str, Query]:
    return {**dashboard_queries(), **ml_queries()}
