"""Table contracts: raw source columns, types, and the model feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Default source file names, keyed by table; callers pass their own map where files are named otherwise.
DATA_FILES = {
    "orders": "orders.csv",
    "customers": "customers.csv",
    "items": "order_items.csv",
    "payments": "order_payments.csv",
    "reviews": "order_reviews.csv",
    "products": "products.csv",
    "sellers": "sellers.csv",
    "translation": "category_translation.csv",
}

# Features known when an order is placed, in the order the model expects.
NUMERIC_FEATURES = ["total_sales", "total_freight", "item_count", "estimated_delivery_days", "purchase_month"]
CATEGORICAL_FEATURES = ["product_category", "customer_state", "seller_state"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
TARGET = "is_late"
RANDOM_STATE = 42

# Cell texts that pandas' CSV reader turns into missing values by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# ---------------------------------------------------------------------------

MONEY_PRICE = T.DecimalType(22, 2)
MONEY_VALUE = T.DecimalType(24, 4)
TS_TEXT = T.StringType()  # timestamps arrive as text and are parsed in the mart

# Columns the pipeline reads from each raw table, with the type every source
# must deliver. Sources may carry more columns; orders passes them through.
RAW_COLUMNS: dict[str, dict[str, T.DataType]] = {
    "orders": {
        "order_id": T.StringType(),
        "customer_id": T.StringType(),
        "order_status": T.StringType(),
        "order_purchase_timestamp": TS_TEXT,
        "order_delivered_customer_date": TS_TEXT,
        "order_estimated_delivery_date": TS_TEXT,
    },
    "customers": {
        "customer_id": T.StringType(),
        "customer_unique_id": T.StringType(),
        "customer_state": T.StringType(),
    },
    "items": {
        "order_id": T.StringType(),
        "order_item_id": T.IntegerType(),
        "product_id": T.StringType(),
        "seller_id": T.StringType(),
        "price": MONEY_PRICE,
        "freight_value": MONEY_VALUE,
    },
    "payments": {
        "order_id": T.StringType(),
        "payment_value": MONEY_VALUE,
    },
    "reviews": {
        "order_id": T.StringType(),
        "review_score": T.IntegerType(),
    },
    "products": {
        "product_id": T.StringType(),
        "product_category_name": T.StringType(),
    },
    "sellers": {
        "seller_id": T.StringType(),
        "seller_state": T.StringType(),
    },
    "translation": {
        "product_category_name": T.StringType(),
        "product_category_name_english": T.StringType(),
    },
}

# Typed extra columns that are not strings.
CSV_EXTRA_TYPES: dict[str, dict[str, T.DataType]] = {
    "payments": {"payment_sequential": T.IntegerType(), "payment_installments": T.IntegerType()},
    "customers": {"customer_zip_code_prefix": T.StringType()},
}

# Tables de-duplicated by key keeping the first row in file order.
KEEP_FIRST_KEYS = {
    "orders": "order_id",
    "customers": "customer_id",
    "products": "product_id",
    "sellers": "seller_id",
    "translation": "product_category_name",
}
# Tables de-duplicated on whole rows.
DISTINCT_ROW_TABLES = ("items", "payments", "reviews")

# Ingest position column: struct(file, block, row) ordering rows as in the file.
INGEST_COL = "_ingest_pos"

ORDER_TIMESTAMPS = [
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

MART_DERIVED = [
    "customer_unique_id",
    "customer_state",
    "item_count",
    "total_sales",
    "total_freight",
    "product_category",
    "seller_state",
    "total_payment_value",
    "average_review_score",
    "purchase_month",
    "purchase_period",
    "estimated_delivery_days",
    "delivery_days",
    "is_late",
    "delivery_status",
]
