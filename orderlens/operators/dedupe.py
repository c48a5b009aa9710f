"""De-duplication: keep-first by key, and whole-row distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.schemas import INGEST_COL


def keep_first(df: DataFrame, key: str, order_col: str = INGEST_COL) -> DataFrame:
    """One row per ``key``: the first in file order (pandas ``drop_duplicates(key)``).

    ``row_number() = 1`` plans as a window group limit applied before and after
    the shuffle, so a key repeated on many rows ships one row per map task.
    Null keys form one group, as in pandas.
    """
    w = Window.partitionBy(key).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", order_col)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (map-side partial distinct, then one shuffle)."""
    if INGEST_COL in df.columns:
        df = df.drop(INGEST_COL)
    return df.dropDuplicates()
