"""The node table's walk against the library's probabilities; per-tree forests; groups of trees."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from orderlens.ml import nodes as N
from orderlens.ml.model import ForestParams, fit, predict
from orderlens.ml.score import score_orders

PARAMS = ForestParams(num_trees=12, max_depth=8, cache_node_ids=False)


@pytest.fixture(scope="module")
def train(spark):
    k = F.col("id")
    return spark.range(3000).select(
        F.concat(F.lit("o"), "id").alias("order_id"), (k * 37 % 500 + 1).cast("double").alias("total_sales"),
        (k * 13 % 90).cast("double").alias("total_freight"), (k % 4 + 1).cast("double").alias("item_count"),
        (k * 7 % 40 + 1).cast("double").alias("estimated_delivery_days"), (k % 12 + 1).cast("double").alias("purchase_month"),
        F.concat(F.lit("c"), k % 9).alias("product_category"), F.concat(F.lit("s"), k * 5 % 7).alias("customer_state"),
        F.concat(F.lit("t"), k % 3).alias("seller_state"),
        (((k * 13 % 90 > 50).cast("int") + (k % 9 == 4).cast("int") + (k * 31 % 11 == 0).cast("int")) % 2).cast("int").alias("label")).cache()


@pytest.fixture(scope="module")
def model(train):
    return fit(train, PARAMS)


def test_two_hundred_probabilities_equal_the_library(spark, train, model):
    nodes = N.node_table(model, spark)
    rows = train.where("order_id < 'o12'")
    rows = rows.withColumn("product_category", F.when(F.col("item_count") == 2, "unseen").otherwise(F.col("product_category")))
    want = {r["order_id"]: r["p"] for r in model.transform(rows).select("order_id", vector_to_array("probability")[1].alias("p")).collect()}
    assert len(want) >= 200 and len(set(want.values())) > 50
    got = {r["order_id"]: r["late_probability"] for r in N.late_probabilities(N.encoder_of(model).transform(rows), nodes).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    whole = {r["order_id"]: (r["prediction"], r["verdict"]) for r in score_orders(model, rows).collect()}
    walked = {r["order_id"]: (r["prediction"], r["verdict"]) for r in N.score_with_nodes(N.encoder_of(model), nodes, rows).collect()}
    assert whole == walked


def test_groups_of_trees_give_the_same_sums(spark, train, model):
    nodes = N.node_table(model, spark)
    biggest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] * N.NODE_BYTES
    groups = N.tree_groups(nodes, biggest * 2)
    assert len(groups) > 3 and [t for a, b in groups for t in range(a, b + 1)] == list(range(12))
    vectors = N.encoder_of(model).transform(train.where("order_id < 'o14'"))
    one = {r[0]: r[1] for r in N.late_probabilities(vectors, nodes).collect()}
    many = {r[0]: r[1] for r in N.late_probabilities(vectors, nodes, group_bytes=biggest * 2).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_a_forest_of_weighted_samples_learns(spark, train):
    encoder, nodes = N.fit_per_tree(train, ForestParams(num_trees=3, max_depth=8, cache_node_ids=False))
    assert sorted(r["tree"] for r in nodes.select("tree").distinct().collect()) == [0, 1, 2]
    scored = N.score_with_nodes(encoder, nodes, train).join(train.select("order_id", "label"), "order_id")
    assert scored.count() == 3000
    assert scored.where("prediction = label").count() > 2400
    # both classes weigh the same at every root
    for r in nodes.where("node = 0").collect():
        assert r["late"] == pytest.approx(0.5, abs=1e-9)
    joint = predict(fit(train, PARAMS), train).where("prediction = label").count()
    assert abs(joint - scored.where("prediction = label").count()) < 500


def test_saved_nodes_score_as_before(spark, train, model, tmp_path):
    nodes = N.node_table(model, spark)
    N.save_nodes(N.encoder_of(model), nodes, str(tmp_path / "f"))
    encoder, again = N.load_nodes(spark, str(tmp_path / "f"))
    rows = train.where("order_id < 'o11'")
    want = {r["order_id"]: r["late_probability"] for r in score_orders(model, rows).collect()}
    got = {r["order_id"]: r["late_probability"] for r in N.score_with_nodes(encoder, again, rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
