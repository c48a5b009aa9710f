"""Dashboard job: raw tables -> materialised mart -> filtered view -> metric tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.config import checkpoint_root
from orderlens.operators import findings, metrics
from orderlens.operators.joins import cardinality_errors
from orderlens.operators.mart import build_order_mart
from orderlens.operators.quality import check_mart
from orderlens.sources.fixture import fixture_tables
from orderlens.sources.mart_store import UnpublishedTableError, materialized, open_published, publish, source_key
from orderlens.sources.tables import RawTables


def fixture_raw(spark: SparkSession, sf_dir: str) -> RawTables:
    return fixture_tables(spark, sf_dir)


FIXTURE_TABLES = ["nation", "customer", "orders", "lineitem", "events", "part", "supplier"]


def fixture_key(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the test tables that the raw tables are made of."""
    return source_key(spark, *[f"{sf_dir.rstrip('/')}/{name}.parquet" for name in FIXTURE_TABLES])


def mart_from(spark: SparkSession, raw: Callable[[], RawTables], key: str) -> DataFrame:
    """The order mart for the state ``key`` of its sources; ``raw`` is called only if it must be built."""
    with cardinality_errors():
        return materialized(spark, "mart", key, lambda: build_order_mart(raw()), check=check_mart)


def publish_mart(raw: RawTables, out: str, key: str, partition_by_month: bool = False) -> DataFrame:
    """Build the mart into the store ``out``; readers see it only after it has passed its checks."""
    with cardinality_errors():
        return publish(build_order_mart(raw), out, key, check_mart, ["purchase_period"] if partition_by_month else [])


def open_mart(spark: SparkSession, path: str) -> DataFrame:
    """The published mart of a store; a plain Parquet folder is checked before it is used."""
    try:
        return open_published(spark, path)
    except UnpublishedTableError:
        mart = spark.read.parquet(path)
        check_mart(mart)
        return mart


def fixture_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_from(spark, lambda: fixture_raw(spark, sf_dir), fixture_key(spark, sf_dir))


KPI_COLUMNS = [
    "total_revenue", "total_freight", "total_orders", "late_orders", "average_order_value", "average_delivery",
    "late_rate", "on_time_rate", "average_review", "freight_share", "minimum_group_orders",
]
CONCENTRATION_COLUMNS = [
    "top_category", "top_category_share", "top_state", "top_state_share", "top_three_category_share",
]


@dataclass
class DashboardView:
    """All dashboard tables for one (state, category) filter pair."""

    mart: DataFrame
    state: str | None = None
    category: str | None = None

    @property
    def view(self) -> DataFrame:
        return metrics.filter_view(self.mart, self.state, self.category)

    def tables(self) -> dict[str, DataFrame]:
        """Every table, in five scans of the mart.

        The group summaries and the one-row metrics are computed here, once, and
        checkpointed (one row per group, and one row); the tables read those two.
        """
        v = self.view
        checkpoint_root(v.sparkSession)
        groups = metrics.grouping_table(v).checkpoint(eager=True)
        m = findings.dashboard_metrics(v, groups).checkpoint(eager=True)
        cats, states, months = metrics.split_grouping_table(groups)
        cats = cats.orderBy(F.desc("revenue"), "product_category")
        states = states.orderBy(F.desc("revenue"), "customer_state")
        enough = F.col("orders") >= m.select("minimum_group_orders").scalar()
        riskiest = [F.desc("late_rate"), F.desc("revenue"), F.asc("customer_state")]
        return {
            "kpis": m.select(*KPI_COLUMNS),
            "category_summary": cats,
            "state_summary": states,
            "monthly_revenue": months.orderBy("purchase_period"),
            "top_categories": cats.limit(metrics.TOP_K),
            "top_states": states.limit(metrics.TOP_K),
            "late_rate_by_state_eligible": states.where(enough).orderBy(*riskiest).limit(metrics.TOP_K),
            "category_eligible": cats.where(enough),
            "concentration": m.select(*CONCENTRATION_COLUMNS),
            "peak_period": metrics.peak_from(months),
            "latest_growth": metrics.growth_from(months),
            "repeat_customers": m.select("customers", "repeat_customers", "repeat_rate"),
            "late_delay": m.select("late_orders", "average_late_delay"),
            "review_gap": m.select("review_on_time", "review_late", "review_gap"),
            "risk_leaders": m.select(*[c for c in m.columns if c.startswith("highest_")]),
            "recommendations": findings.recommendations_from(m),
            "insights": findings.insights_from(m),
            "business_status": findings.business_status_from(m),
            "preview": metrics.preview(v),
            "filter_domains": metrics.filter_domains(self.mart, self.state),
        }

    def write(self, out_dir: str) -> None:
        """Write every table as Parquet under ``out_dir/<name>``; sorted ones carry their order as ``rank``."""
        falling = F.desc("revenue")
        order = {"category_summary": [falling, "product_category"], "state_summary": [falling, "customer_state"],
                 "monthly_revenue": ["purchase_period"], "filter_domains": ["domain", "value"]}
        for name, df in self.tables().items():
            df = metrics.with_rank(df, *order[name]) if name in order else df
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
