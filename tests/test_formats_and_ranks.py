"""Half-even texts equal Python's formats; ranks, empty views, tree samples, encoded vectors."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from helpers import mart_rows
from orderlens.functions.formats import fixed_text, percent_text
from orderlens.ml.bootstrap import poisson_limits, tree_samples
from orderlens.ml.model import encoded_rows, encoder_stages, slot_names
from orderlens.operators import findings, metrics as K


def test_texts_equal_python_formats(spark):
    rng = random.Random(1)
    values = [k / 16 for k in range(-40, 40)] + [k / 1000 for k in range(0, 400)] + [rng.uniform(-1e6, 1e6) for _ in range(300)]
    values += [k + 0.5 for k in range(6)] + [k / 8 for k in range(50)] + [rng.random() * 10.0**-e for e in range(20) for _ in range(10)]
    values += [0.15, 0.25, 0.35, 2.675, 1.005, 1e14 + 0.5, 12345678901234.675, 5e-324, 0.05, 0.95, 0.995, 9.995, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", *[fixed_text(F.col("x"), d).alias(f"f{d}") for d in (0, 1, 2)], *[percent_text(F.col("x"), d).alias(f"p{d}") for d in (1, 2)],
        fixed_text(F.col("x"), 2, grouped=True).alias("g"))
    for r in df.collect():
        x = r["x"]
        assert [r["f0"], r["f1"], r["f2"]] == [f"{x:.{d}f}" for d in (0, 1, 2)], x
        assert [r["p1"], r["p2"]] == [f"{x:.{d}%}" for d in (1, 2)], x
        assert r["g"] == f"{x:,.2f}"
    assert spark.createDataFrame([(None,)], "x double").select(fixed_text(F.col("x"), 1)).first()[0] is None
    with pytest.raises(ValueError):
        fixed_text(F.col("x"), 3)


def test_texts_at_exact_ties(spark):
    """A late rate of 1 / 16 reads 6.2%, not 6.3%."""
    view = mart_rows(spark, [dict(is_late=int(i == 0), order_id=f"o{i}") for i in range(16)])
    texts = {r["rule_id"]: r["text"] for r in findings.finding_texts(view).where("kind = 'recommendation'").collect()}
    assert "the 6.2% late rate" in texts["R1"]


def test_ranks_and_empty_views(spark):
    view = mart_rows(spark, [dict(product_category=c, total_sales=s, purchase_period=p) for c, s, p in
                             [("b", 10, "2018-02"), ("a", 10, "2018-01"), ("c", 50, "2018-03"), ("b", 0, "2018-01")]])
    rows = K.sorted_outputs(view).orderBy("output", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["output"], []).append(r["key"])
    assert got["category_summary"] == ["c", "a", "b"]
    assert got["monthly_revenue"] == ["2018-01", "2018-02", "2018-03"]
    assert got["filter_domains"] == sorted(got["filter_domains"])
    none = K.filter_view(view, "nowhere")
    assert findings.finding_texts(none).count() == 0
    kpis = K.kpis(none).first()
    assert kpis["total_orders"] == 0 and kpis["late_rate"] is None and kpis["average_order_value"] is None


def test_the_widest_gap_fires_the_review_rule(spark):
    rows = [dict(customer_state=s, is_late=late, average_review_score=v, order_id=f"{s}{late}{v}")
            for s, late, v in [("SP", 0, 4.5), ("SP", 1, 4.4), ("RJ", 0, 5.0), ("RJ", 1, 2.0), ("AM", 0, 3.0)]]
    view = K.widest_review_gap_view(mart_rows(spark, rows))
    assert {r["customer_state"] for r in view.collect()} == {"RJ"}
    rules = {r["rule_id"]: r["metric_1"] for r in findings.recommendations(view).collect()}
    assert rules["R8"] == 3.0


def test_poisson_limits_are_the_distribution():
    share = [x / 2**60 for x in poisson_limits()]
    assert share[0] == pytest.approx(math.exp(-1), abs=1e-15)
    assert share[2] == pytest.approx(2.5 * math.exp(-1), abs=1e-15)
    assert share == sorted(share) and share[-1] <= 1


def test_tree_samples_weigh_their_own_classes(spark):
    train = spark.range(6000).select(F.concat(F.lit("o"), "id").alias("order_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    samples = tree_samples(train, [0, 5])
    rows = samples.groupBy("tree", "label").agg(F.sum("copies").alias("n"), F.sum("weight").alias("w"), F.max("copies").alias("m")).collect()
    for tree in (0, 5):
        mine = {r["label"]: r for r in rows if r["tree"] == tree}
        total = mine[0]["n"] + mine[1]["n"]
        assert abs(total - 6000) < 400 and mine[0]["m"] >= 4
        for c in (0, 1):  # both classes weigh the same in each sample
            assert mine[c]["w"] == pytest.approx(total / 2)
    again = tree_samples(train.repartition(5), [5, 0])
    key = ["order_id", "tree", "copies", "weight"]
    assert sorted(again.select(*key).collect()) == sorted(samples.select(*key).collect())


def test_encoded_rows_name_their_slots(spark):
    schema = ("order_id string, total_sales double, total_freight double, item_count double, estimated_delivery_days double, "
              "purchase_month double, product_category string, customer_state string, seller_state string")
    train = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0, "x", "SP", "RJ"), ("b", 3.0, 2.0, 3.0, 4.0, 5.0, "y", "SP", "SP"),
                                   ("c", None, 2.0, 3.0, 4.0, 5.0, "x", "RJ", "SP")], schema)
    model = Pipeline(stages=encoder_stages()).fit(train)
    assert slot_names(model)[5:] == ["product_category=x", "product_category=y", "customer_state=RJ", "customer_state=SP",
                                     "seller_state=RJ", "seller_state=SP"]
    new = spark.createDataFrame([("n", None, 0.0, 1.0, 2.0, 3.0, "new", None, "RJ")], schema)
    got = {r["slot"]: r["value"] for r in encoded_rows(model, new).collect()}
    assert got == {"total_sales": 2.0, "item_count": 1.0, "estimated_delivery_days": 2.0, "purchase_month": 3.0,
                   "customer_state=SP": 1.0, "seller_state=RJ": 1.0}
