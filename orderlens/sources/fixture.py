"""Map the driver's TPC-H-style Parquet tables onto the eight raw order tables.

The mapping is arithmetic on keys (SURVEY section 7.2), so the DuckDB oracle can
reproduce it exactly. Every table is derived from the given Parquet files and
grows with them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schemas import INGEST_COL, MONEY_PRICE, MONEY_VALUE
from orderlens.sources.tables import RawTables

# --- fixed values -----------------------------------------------------------
# Brands left out of the translation table, so their untranslated name is used.
UNTRANSLATED_BRANDS = ["Brand#7", "Brand#13"]
# Every 50th order's line items are duplicated to exercise whole-row dedupe.
DUPLICATE_ITEMS_EVERY = 50
# Every 97th order has no delivery timestamp; every 40th part has no category.
NO_DELIVERY_EVERY = 97
NO_CATEGORY_EVERY = 40
# Every so many keys a table holds a second, later row of the key with other values;
# keep-first de-duplication must drop it.
LATER_COPY_EVERY = {"orders": 61, "customers": 53, "products": 47, "sellers": 7}
STALE = "stale"
# ---------------------------------------------------------------------------


def _parquet_pos() -> Column:
    """File order of a Parquet row: (file, 0, row index within the file)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.lit(0).cast(T.LongType()).alias("block"),
        F.col("_metadata.row_index").alias("row"),
    )


def _key(c: str) -> Column:
    return F.col(c).cast(T.StringType())


def _with_later_copies(df: DataFrame, key: str, every: int) -> DataFrame:
    """Every ``every``-th key twice: ``_copy`` is 1 on the second row, which comes later in file order."""
    copies = F.when(F.col(key) % every == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pos = F.col(INGEST_COL)
    return df.withColumn("_copy", F.explode(copies)).withColumn(
        INGEST_COL,
        F.struct(pos["file"].alias("file"), F.col("_copy").cast(T.LongType()).alias("block"), pos["row"].alias("row")),
    )


def with_text_timestamps(raw: RawTables) -> RawTables:
    """The raw tables with the orders' timestamps as text, in several forms, some of them no timestamps."""
    k = F.col("order_id").cast(T.LongType())

    def text(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    purchase = (
        F.when(k % 8 == 2, F.date_format("order_purchase_timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 8 == 3, "not a date").when(k % 8 == 4, "").when(k % 8 == 5, "2018-13-45 00:00:00")
        .when(k % 8 == 6, F.date_format("order_purchase_timestamp", "yyyy-MM-dd"))
        .otherwise(F.concat(text("order_purchase_timestamp"), F.lit(".250000"))))
    delivered = F.when(k % 9 == 1, "unknown").otherwise(text("order_delivered_customer_date"))
    return replace(raw, orders=raw.orders.withColumns({
        "order_purchase_timestamp": purchase, "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": text("order_estimated_delivery_date")}))


def fixture_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """Raw order tables derived from ``{sf_dir}/*.parquet``."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    nation = read("nation").select("n_nationkey", "n_name")
    customer =read("customer").select("c_custkey", "c_nationkey", _parquet_pos().alias(INGEST_COL))
    o = read("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
        _parquet_pos().alias(INGEST_COL),
    )
    oc = o.join(customer.select("c_custkey", "c_nationkey"), o.o_custkey == customer.c_custkey, "left")
    k = F.col("o_orderkey")
    delivered = F.col("o_orderdate") + F.make_dt_interval(
        (F.lit(3) + (k * 7919) % 28 + F.col("c_nationkey") % 5).cast(T.IntegerType()),
        ((k * 31) % 24).cast(T.IntegerType()),
    )
    estimate_days = F.lit(22) + 3 * F.substring("o_orderpriority", 1, 1).cast(T.IntegerType())
    is_delivered = F.col("o_orderstatus").isin("F", "P") & (F.col("_copy") == 0)
    orders = _with_later_copies(oc, "o_orderkey", LATER_COPY_EVERY["orders"]).select(
        _key("o_orderkey").alias("order_id"),
        _key("o_custkey").alias("customer_id"),
        F.when(is_delivered, F.lit("delivered")).otherwise(F.lit("canceled")).alias("order_status"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast(T.IntegerType()))).alias("order_purchase_timestamp"),
        F.when(k % NO_DELIVERY_EVERY == 0, F.lit(None).cast(T.TimestampNTZType())).otherwise(delivered).alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.make_dt_interval(estimate_days.cast(T.IntegerType()))).alias("order_estimated_delivery_date"),
        INGEST_COL,
    )

    def current(c: str) -> Column:
        return F.when(F.col("_copy") == 1, F.lit(STALE)).otherwise(F.col(c))

    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    customers = _with_later_copies(customers, "c_custkey", LATER_COPY_EVERY["customers"]).select(
        _key("c_custkey").alias("customer_id"),
        _key("c_custkey").alias("customer_unique_id"),
        current("n_name").alias("customer_state"),
        INGEST_COL,
    )

    li = read("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_extendedprice").cast(MONEY_PRICE).alias("price"),
        (F.col("l_tax").cast(T.DecimalType(4, 2)) + F.col("l_discount").cast(T.DecimalType(4, 2))).alias("_rate"),
    ).withColumn("freight_value", (F.col("price") * F.col("_rate")).cast(MONEY_VALUE))
    item_rows = li.unionByName(li.where(F.col("l_orderkey") % DUPLICATE_ITEMS_EVERY == 0))
    items = item_rows.select(
        _key("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast(T.IntegerType()).alias("order_item_id"),
        _key("l_partkey").alias("product_id"),
        _key("l_suppkey").alias("seller_id"),
        "price",
        "freight_value",
    )
    payments = li.select(
        _key("l_orderkey").alias("order_id"),
        (F.col("price") + F.col("freight_value")).cast(MONEY_VALUE).alias("payment_value"),
    )

    ev = read("events").select("event_id", "value")
    reviews = ev.select(
        F.expr("(event_id * 3) div 4").cast(T.StringType()).alias("order_id"),
        (F.lit(1) + F.floor("value").cast(T.IntegerType()) % 5).cast(T.IntegerType()).alias("review_score"),
    )

    part = read("part").select("p_partkey", "p_brand", _parquet_pos().alias(INGEST_COL))
    products = _with_later_copies(part, "p_partkey", LATER_COPY_EVERY["products"]).select(
        _key("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % NO_CATEGORY_EVERY == 0, F.lit(None).cast(T.StringType()))
        .otherwise(current("p_brand")).alias("product_category_name"),
        INGEST_COL,
    )
    translation = (
        part.where(~F.col("p_brand").isin(UNTRANSLATED_BRANDS))
        .groupBy("p_brand")
        .agg(F.min(INGEST_COL).alias(INGEST_COL))
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.concat(F.lit("cat_"), F.expr("substring(p_brand, 7)")).alias("product_category_name_english"),
            INGEST_COL,
        )
    )

    supplier = read("supplier").select("s_suppkey", "s_nationkey", _parquet_pos().alias(INGEST_COL))
    sellers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    sellers = _with_later_copies(sellers, "s_suppkey", LATER_COPY_EVERY["sellers"]).select(
        _key("s_suppkey").alias("seller_id"),
        current("n_name").alias("seller_state"),
        INGEST_COL,
    )

    tables = RawTables(
        orders=orders,
        customers=customers,
        items=items,
        payments=payments,
        reviews=reviews,
        products=products,
        sellers=sellers,
        translation=translation,
    )
    tables.validate()
    return tables
