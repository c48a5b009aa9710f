"""A fitted forest as an encoder and a table of nodes: fitted per tree, written, read and scored without the model object."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.ml.bootstrap import tree_samples
from orderlens.ml.model import ForestParams, encoder_stages, forest_estimator, load_model
from orderlens.ml.score import verdicts
from orderlens.ml.walk import (  # noqa: F401
    GROUP_BYTES, NODE_BYTES, _nodes_of, encoder_of, late_probabilities, node_table, tree_groups,
)
from orderlens.sources.mart_store import store_path, stored


def save_nodes(encoder: PipelineModel, nodes: DataFrame, path: str) -> None:
    encoder.write().overwrite().save(f"{path}/encoder")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def load_nodes(spark, path: str) -> tuple[PipelineModel, DataFrame]:
    return load_model(f"{path}/encoder"), spark.read.parquet(f"{path}/nodes")


def fit_per_tree(train: DataFrame, params: ForestParams = ForestParams(), parallel: int = 4) -> tuple[PipelineModel, DataFrame]:
    """Encoder and node table of a forest whose trees each see their own weighted bootstrap sample.

    This is ``balanced_subsample``: a tree is fitted alone on its sample (``tree_samples``),
    ``parallel`` of them at a time. It costs one pass per level and tree, where the joint fit
    (``model.fit``, global class weights) shares passes among trees.
    """
    spark = train.sparkSession
    encoder = Pipeline(stages=encoder_stages()).fit(train)
    root = store_path(spark, "forest", uuid.uuid4().hex)

    def one(tree: int) -> None:
        sample = encoder.transform(tree_samples(train, [tree], seed=params.seed)).select("label", "weight", "features")
        forest = forest_estimator(params, trees=1, seed=params.seed + tree).setBootstrap(False).setWeightCol("weight")
        forest.fit(sample).write().save(f"{root}/{tree}")

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(one, range(params.num_trees)))
    trees = [_nodes_of(spark.read.parquet(f"{root}/{t}/data")).withColumn("tree", F.lit(t)) for t in range(params.num_trees)]
    return encoder, stored(reduce(DataFrame.unionByName, trees), "nodes")


def score_with_nodes(encoder: PipelineModel, nodes: DataFrame, orders: DataFrame, key: str = "order_id",
                     group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Prediction, late probability and verdict per order (``feature_frame`` columns), as ``score_orders`` gives them."""
    scored = late_probabilities(encoder.transform(orders), nodes, key, group_bytes)
    p = F.col("late_probability")
    return verdicts(scored.withColumn("prediction", (p > 0.5).cast("int")), p, [key])
