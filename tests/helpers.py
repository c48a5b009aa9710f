"""Hand-made raw tables for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from orderlens.sources.tables import RawTables

POS = "_ingest_pos struct<file:string,block:bigint,row:bigint>"


def _pos(rows):
    return [tuple(r) + (("f", 0, i),) for i, r in enumerate(rows)]


def D(x):
    return None if x is None else Decimal(str(x))


def raw_tables(spark, orders, items, customers=None, payments=(), reviews=(), products=None,
               sellers=None, translation=()):
    """Build RawTables. ``orders``: (id, customer, status, purchase, delivered, estimated).
    ``items``: (order_id, item_id, product_id, seller_id, price, freight)."""
    customers = customers if customers is not None else sorted({(o[1], "u" + o[1], "SP") for o in orders})
    products = products if products is not None else sorted({(i[2], "cat_x") for i in items if i[2]})
    sellers = sellers if sellers is not None else sorted({(i[3], "RJ") for i in items if i[3]})
    return RawTables(
        orders=spark.createDataFrame(_pos(orders), "order_id string, customer_id string, order_status string, "
                                     "order_purchase_timestamp string, order_delivered_customer_date string, "
                                     "order_estimated_delivery_date string, " + POS),
        customers=spark.createDataFrame(_pos(customers), "customer_id string, customer_unique_id string, "
                                        "customer_state string, " + POS),
        items=spark.createDataFrame([(a, b, c, d, D(e), D(f)) for a, b, c, d, e, f in items],
                                    "order_id string, order_item_id int, product_id string, seller_id string, "
                                    "price decimal(12,2), freight_value decimal(18,4)"),
        payments=spark.createDataFrame([(a, D(b)) for a, b in payments], "order_id string, payment_value decimal(18,4)"),
        reviews=spark.createDataFrame(list(reviews), "order_id string, review_score int"),
        products=spark.createDataFrame(_pos(products), "product_id string, product_category_name string, " + POS),
        sellers=spark.createDataFrame(_pos(sellers), "seller_id string, seller_state string, " + POS),
        translation=spark.createDataFrame(_pos(translation), "product_category_name string, "
                                          "product_category_name_english string, " + POS),
    )


def order(oid, cust="c1", status="delivered", purchase="2018-01-10 10:00:00",
          delivered="2018-01-15 10:00:00", estimated="2018-01-20 00:00:00"):
    return (oid, cust, status, purchase, delivered, estimated)


MART_SCHEMA = (
    "order_id string, customer_unique_id string, customer_state string, product_category string, "
    "seller_state string, total_sales decimal(22,2), total_freight decimal(28,4), average_review_score double, "
    "purchase_period string, estimated_delivery_days double, delivery_days double, is_late int, "
    "delivery_status string"
)


def mart_rows(spark, rows):
    """A minimal mart: rows of dicts with defaults for every column."""
    base = dict(customer_unique_id="u1", customer_state="SP", product_category="a", seller_state="RJ",
                total_sales=100, total_freight=10, average_review_score=4.0, purchase_period="2018-01",
                estimated_delivery_days=10.0, delivery_days=8.0, is_late=0)
    out = []
    for i, r in enumerate(rows):
        x = {**base, **r}
        x.setdefault("order_id", f"o{i}")
        out.append((x["order_id"], x["customer_unique_id"], x["customer_state"], x["product_category"],
                    x["seller_state"], D(x["total_sales"]), D(x["total_freight"]), x["average_review_score"],
                    x["purchase_period"], x["estimated_delivery_days"], x["delivery_days"], x["is_late"],
                    "Late" if x["is_late"] else "On Time"))
    return spark.createDataFrame(out, MART_SCHEMA)


def ts(s):
    return dt.datetime.fromisoformat(s)
