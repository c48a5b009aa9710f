"""Batch scoring of orders with a trained pipeline, with input-domain checks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.ml.model import feature_frame
from orderlens.ml.walk import encoder_of, late_probabilities, node_table

# --- fixed values -----------------------------------------------------------
# Input domains of the scoring form: money >= 0, items >= 1, days >= 1, month 1..12.
MIN_ITEMS = 1
MIN_ESTIMATED_DAYS = 1.0
MONTHS = (1, 12)
VERDICT_LATE = "Likely Late"
VERDICT_ON_TIME = "Likely On Time"
# ---------------------------------------------------------------------------


def domain_violation(df: DataFrame) -> Column:
    """Text naming the first broken input rule, or null when the row is valid."""
    c = F.col
    return (
        F.when(c("total_sales").isNull() | (c("total_sales") < 0), "total_sales must be >= 0")
        .when(c("total_freight").isNull() | (c("total_freight") < 0), "total_freight must be >= 0")
        .when(c("item_count").isNull() | (c("item_count") < MIN_ITEMS), "item_count must be >= 1")
        .when(c("estimated_delivery_days").isNull() | (c("estimated_delivery_days") < MIN_ESTIMATED_DAYS),
              "estimated_delivery_days must be >= 1")
        .when(c("purchase_month").isNull() | ~c("purchase_month").between(*MONTHS), "purchase_month must be 1..12")
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a ``reject_reason``)."""
    tagged = df.withColumn("reject_reason", domain_violation(df))
    return (
        tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        tagged.where(F.col("reject_reason").isNotNull()),
    )


def score_orders(model: PipelineModel, orders: DataFrame, keep: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """Prediction, late probability and verdict per order, by the walk of the forest's nodes.

    ``shown_probability`` is the probability of the verdict: p for
    'Likely Late', 1 - p for 'Likely On Time'.
    """
    feats = feature_frame(orders, keep=keep)
    kept = [c for c in keep if c in feats.columns]
    out = late_probabilities(encoder_of(model).transform(feats), node_table(model, feats.sparkSession), keep=kept)
    p = F.col("late_probability")
    return verdicts(out.withColumn("prediction", (p > 0.5).cast("int")), p, kept)


def library_scores(model: PipelineModel, orders: DataFrame, keep: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """``score_orders`` by the library's own ``transform``, which visits all trees row by row: what the walk is held against."""
    feats = feature_frame(orders, keep=keep)
    out = model.transform(feats).withColumn("_prob", vector_to_array("probability"))
    return verdicts(out, F.col("_prob")[1], [c for c in keep if c in feats.columns])


def verdicts(scored: DataFrame, p: Column, keep: list[str]) -> DataFrame:
    """Class, late probability ``p``, verdict and the verdict's probability of scored rows (``prediction``)."""
    late = F.col("prediction") == 1
    return scored.select(
        *keep,
        F.col("prediction").cast(T.IntegerType()).alias("prediction"),
        p.alias("late_probability"),
        F.when(late, VERDICT_LATE).otherwise(VERDICT_ON_TIME).alias("verdict"),
        F.when(late, p).otherwise(F.lit(1.0) - p).alias("shown_probability"),
    )
