"""CSV catalog: header names, BOM, pandas NA tokens, keep-first file order, quoted line breaks."""

from __future__ import annotations

import os
import tempfile

import pytest

from orderlens.operators.mart import build_order_mart
from orderlens.schemas import DATA_FILES
from orderlens.sources.csv_tables import CsvCellError, csv_tables, read_csv_table

FILES = {
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
              "o1,c1,delivered,2018-01-10 10:00:00,,,2018-01-15 10:00:00,2018-01-20 00:00:00\n"
              "o2,c2,canceled,2018-01-10 10:00:00,,,2018-01-15 10:00:00,2018-01-20 00:00:00\n"
              "o2,c2,delivered,2018-01-10 10:00:00,,,2018-01-15 10:00:00,2018-01-20 00:00:00\n"
              "o3,c1,delivered,2018-02-01 09:00:00,,,NA,2018-02-20 00:00:00\n"
              "o4,c9,delivered,2018-02-01 09:00:00,,,2018-02-25 00:00:01,2018-02-25 00:00:00\n",
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01000,sao paulo,SP\nc1,u1b,01000,rio,RJ\nc2,u2,02000,rio,null\n",
    "items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
             "o1,1,p1,s1,2018-01-12 00:00:00,10.50,1.25\n"
             "o1,1,p1,s1,2018-01-12 00:00:00,10.50,1.25\n"
             "o2,1,p2,s1,2018-01-12 00:00:00,NaN,2.00\n"
             "o4,1,p2,s2,2018-01-12 00:00:00,5.00,N/A\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                "o1,1,credit_card,1,11.75\no1,1,credit_card,1,11.75\n",
    "reviews": 'review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,'
               'review_answer_timestamp\n'
               'r1,o1,5,,"great,\nsecond line",2018-01-16 00:00:00,2018-01-17 00:00:00\n'
               'r2,o1,2,,,2018-01-16 00:00:00,2018-01-17 00:00:00\n',
    "products": "product_id,product_category_name,product_name_lenght\np1,beleza_saude,10\np2,,12\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,x,SP\ns2,2,y,NA\n",
    "translation": "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty",
}


def test_csv_catalog_end_to_end(spark):
    d = tempfile.mkdtemp()
    for name, body in FILES.items():
        with open(os.path.join(d, DATA_FILES[name]), "w", encoding="utf-8") as fh:
            fh.write(body)
    raw = csv_tables(spark, d)
    assert "product_category_name" in raw.translation.columns
    assert raw.reviews.count() == 2  # the quoted line break stays inside one row
    mart = {r["order_id"]: r for r in build_order_mart(raw).collect()}
    assert set(mart) == {"o1", "o4"}  # o2: first copy canceled; o3: NA delivery date
    o1 = mart["o1"]
    assert (o1["item_count"], str(o1["total_sales"]), str(o1["total_freight"])) == (1, "10.50", "1.2500")
    assert o1["product_category"] == "health_beauty" and o1["customer_state"] == "SP"
    assert str(o1["total_payment_value"]) == "11.7500" and o1["average_review_score"] == 3.5
    o4 = mart["o4"]
    assert o4["is_late"] == 1 and o4["customer_state"] == "Unknown"
    assert o4["seller_state"] == "Unknown" and o4["product_category"] == "Unknown"
    assert str(o4["total_freight"]) == "0.0000"


def _folder(files):
    d = tempfile.mkdtemp()
    for name, body in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(body)
    return d


@pytest.mark.parametrize("price", ["12345678901234567890123.00", "R$ 5.00", "1.2345678901"])
def test_money_that_does_not_fit_raises(spark, price):
    d = _folder({"a.csv": "order_id,order_item_id,product_id,seller_id,price,freight_value\n" f"o1,1,p,s,{price},1.00\n"})
    with pytest.raises(CsvCellError, match="price"):
        read_csv_table(spark, d, "items")
    assert read_csv_table(spark, d, "items", on_bad_cell="null").count() == 1


def test_large_money_is_kept(spark):
    d = _folder({"a.csv": "order_id,payment_value\no1,12345678901234567.00\n"})
    assert str(read_csv_table(spark, d, "payments").first()["payment_value"]) == "12345678901234567.0000"


def test_files_with_another_column_order_keep_their_names(spark):
    d = _folder({"a.csv": "customer_id,customer_unique_id,customer_state\nc1,u1,SP\n",
                 "b.csv": "customer_state,customer_id,customer_unique_id\nRJ,c2,u2\n"})
    rows = read_csv_table(spark, d, "customers").select("customer_id", "customer_unique_id", "customer_state").collect()
    assert sorted(map(tuple, rows)) == [("c1", "u1", "SP"), ("c2", "u2", "RJ")]


def test_quoted_line_break_outside_reviews_stays_in_its_row(spark):
    d = _folder({"a.csv": 'seller_id,seller_city,seller_state\ns1,"rio\nde janeiro",RJ\n'})
    rows = read_csv_table(spark, d, "sellers").collect()
    assert [(r["seller_id"], r["seller_state"]) for r in rows] == [("s1", "RJ")]
