"""Score orders as they arrive (Structured Streaming).

New order files (Parquet, the eight model features plus ``order_id``) land in a
folder; each micro-batch is validated and scored with the saved pipeline.
Scores and rejects are written per batch id, so a batch replayed after a
failure overwrites its own output: the sink is idempotent and the checkpoint
gives exactly-once results. Scoring is stateless, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderlens.ml.score import score_orders, split_valid

ORDER_INPUT_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("total_sales", T.DoubleType()),
    T.StructField("total_freight", T.DoubleType()),
    T.StructField("item_count", T.LongType()),
    T.StructField("estimated_delivery_days", T.DoubleType()),
    T.StructField("purchase_month", T.IntegerType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("customer_state", T.StringType()),
    T.StructField("seller_state", T.StringType()),
])


def scoring_batch_writer(model: PipelineModel, out_dir: str, rejects_dir: str):
    """``foreachBatch`` function: validate, score, write both outputs under the batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        valid, rejects = split_valid(batch)
        score_orders(model, valid).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")

    return write


def start_scoring_stream(
    spark: SparkSession,
    model: PipelineModel,
    source_dir: str,
    out_dir: str,
    rejects_dir: str,
    checkpoint_dir: str,
    available_now: bool = False,
    max_files_per_trigger: int = 100,
) -> StreamingQuery:
    stream = (
        spark.readStream.schema(ORDER_INPUT_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )
    writer = (
        stream.writeStream.foreachBatch(scoring_batch_writer(model, out_dir, rejects_dir))
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
