"""Order mart: one row per delivered order with its items, payments and reviews.

Step order follows the source semantics: orders are de-duplicated *before* the
delivered filter; items, payments and reviews are collapsed to one row per
order *before* they meet the orders, so no join fans out.

Shuffle layout: the item, payment and review summaries and the de-duplicated
orders all hash-partition on ``order_id``, so the three order-level joins reuse
that partitioning; the customer join comes last, on the smaller delivered set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.aggregates import mode_or_unknown
from orderlens.functions.columns import (
    delivery_status,
    fill_unknown,
    fractional_days,
    late_flag,
    parse_timestamp,
    purchase_period,
)
from orderlens.operators.dedupe import distinct_rows, keep_first
from orderlens.operators.joins import left_join_dim
from orderlens.schemas import CATEGORICAL_FEATURES, INGEST_COL, MART_DERIVED, ORDER_TIMESTAMPS
from orderlens.sources.tables import RawTables

TOTAL_SALES = T.DecimalType(22, 2)
TOTAL_VALUE = T.DecimalType(28, 4)


def delivered_orders(raw: RawTables) -> DataFrame:
    """Orders kept first-by-id, timestamps parsed, then only delivered with all 3 dates."""
    orders = keep_first(raw.orders, "order_id")
    for c in ORDER_TIMESTAMPS:
        orders = orders.withColumn(c, parse_timestamp(c))
    complete = F.lit(True)
    for c in ORDER_TIMESTAMPS:
        complete = complete & F.col(c).isNotNull()
    return orders.where((F.col("order_status") == "delivered") & complete)


def product_dim_translated(raw: RawTables) -> DataFrame:
    """``(product_id, product_category)``: English category name, else the original."""
    products = keep_first(raw.products, "product_id").select("product_id", "product_category_name")
    translation = keep_first(raw.translation, "product_category_name").select(
        "product_category_name", "product_category_name_english"
    )
    joined = left_join_dim(products, translation, "product_category_name", "translation")
    return joined.select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category"),
    )


def sellers_dim(raw: RawTables) -> DataFrame:
    return keep_first(raw.sellers, "seller_id").select("seller_id", "seller_state")


def items_enriched(raw: RawTables) -> DataFrame:
    """Distinct item rows with product category and seller state attached."""
    items = distinct_rows(raw.items)
    items = left_join_dim(items, product_dim_translated(raw), "product_id", "products")
    return left_join_dim(items, sellers_dim(raw), "seller_id", "sellers")


def item_summary(raw: RawTables) -> DataFrame:
    """Per order: item count, sales, freight, modal category and seller state.

    Partial aggregation runs before the shuffle, so an order with very many
    item rows reaches its reducer as one partial row per map task.
    """
    items = items_enriched(raw).where(F.col("order_id").isNotNull())
    return items.groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"),
        F.coalesce(F.sum("price"), F.lit(0)).cast(TOTAL_SALES).alias("total_sales"),
        F.coalesce(F.sum("freight_value"), F.lit(0)).cast(TOTAL_VALUE).alias("total_freight"),
        mode_or_unknown("product_category").alias("product_category"),
        mode_or_unknown("seller_state").alias("seller_state"),
    )


def payment_summary(raw: RawTables) -> DataFrame:
    """Per order: total payment value over distinct payment rows (all-null sums to 0)."""
    pays = distinct_rows(raw.payments).where(F.col("order_id").isNotNull())
    return pays.groupBy("order_id").agg(
        F.coalesce(F.sum("payment_value"), F.lit(0)).cast(TOTAL_VALUE).alias("total_payment_value")
    )


def review_summary(raw: RawTables) -> DataFrame:
    """Per order: mean review score over distinct review rows."""
    revs = distinct_rows(raw.reviews).where(F.col("order_id").isNotNull())
    return revs.groupBy("order_id").agg(F.avg("review_score").alias("average_review_score"))


def customers_dim(raw: RawTables) -> DataFrame:
    return keep_first(raw.customers, "customer_id").select("customer_id", "customer_unique_id", "customer_state")


def build_order_mart(raw: RawTables) -> DataFrame:
    """The analytical table: one row per delivered order that has items.

    ``order_id`` is unique by construction (orders are unique after keep-first
    and every join is many-to-one, checked while it runs, or one-to-one with a
    summary that is grouped by the order); ``quality.check_mart`` verifies it on
    the written table before it is published.
    """
    orders = delivered_orders(raw)
    order_cols = [c for c in orders.columns if c != INGEST_COL]
    data = (
        orders.join(item_summary(raw), "order_id", "inner")
        .join(payment_summary(raw), "order_id", "left")
        .join(review_summary(raw), "order_id", "left")
    )
    data = left_join_dim(data, customers_dim(raw), "customer_id", "customers")

    purchase = F.col("order_purchase_timestamp")
    data = data.select(
        *order_cols,
        "customer_unique_id",
        fill_unknown("customer_state").alias("customer_state"),
        "item_count",
        "total_sales",
        "total_freight",
        fill_unknown("product_category").alias("product_category"),
        fill_unknown("seller_state").alias("seller_state"),
        "total_payment_value",
        "average_review_score",
        F.month(purchase).alias("purchase_month"),
        purchase_period(purchase).alias("purchase_period"),
        fractional_days(purchase, "order_estimated_delivery_date").alias("estimated_delivery_days"),
        fractional_days(purchase, "order_delivered_customer_date").alias("delivery_days"),
        late_flag("order_delivered_customer_date", "order_estimated_delivery_date").alias("is_late"),
    ).withColumn("delivery_status", delivery_status("is_late"))
    assert set(CATEGORICAL_FEATURES) <= set(data.columns)
    return data.select(*order_cols, *MART_DERIVED)
