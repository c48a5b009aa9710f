"""Data-quality assertions: join cardinality, mart grain, both target classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.schemas import DISTINCT_ROW_TABLES, INGEST_COL, KEEP_FIRST_KEYS
from orderlens.sources.tables import RawTables


class MartQualityError(AssertionError):
    """The mart violates its one-row-per-order grain."""


class TargetClassError(ValueError):
    """The mart lacks one of the two late-delivery classes."""


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once (partial counts before the shuffle)."""
    return df.groupBy(*key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1)


def _check(check_id: str, subject: str, violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").cast(T.LongType()).alias("violations")).select(
        F.lit(check_id).alias("check_id"), F.lit(subject).alias("subject"), "violations"
    )


def dq_violations(raw: RawTables, mart: DataFrame) -> DataFrame:
    """One row per check with its violation count (0 = holds).

    DQ1: keys (or, for items, payments and reviews, whole rows) that a raw table
    holds more than once; de-duplication removes them before the joins.
    DQ2: ``order_id`` is unique in the mart.
    DQ3: the mart holds both target classes (violations = classes missing).
    """
    tables = raw.as_dict()
    checks = [_check("DQ1", f"{name}.{key}", duplicate_keys(tables[name], key)) for name, key in KEEP_FIRST_KEYS.items()]
    for name in DISTINCT_ROW_TABLES:
        rows = tables[name].drop(INGEST_COL)
        checks.append(_check("DQ1", f"{name}.row", duplicate_keys(rows, *rows.columns)))
    checks.append(_check("DQ2", "mart.order_id", duplicate_keys(mart, "order_id")))
    classes = mart.agg(
        (F.lit(2) - F.count_distinct("is_late")).cast(T.LongType()).alias("violations")
    ).select(F.lit("DQ3").alias("check_id"), F.lit("mart.is_late").alias("subject"), "violations")
    return reduce(DataFrame.unionByName, checks + [classes])


def check_mart(mart: DataFrame) -> None:
    """Raise unless the mart has unique order ids and both target classes.

    One aggregate for the classes; the duplicate probe stops at the first hit.
    """
    row = mart.agg(
        F.count_if(F.col("is_late") == 1).alias("late"),
        F.count_if(F.col("is_late") == 0).alias("on_time"),
    ).first()
    if duplicate_keys(mart, "order_id").limit(1).count() > 0:
        raise MartQualityError("the order mart has more than one row for an order_id")
    if not row["late"] or not row["on_time"]:
        raise TargetClassError("the mart needs late and on-time orders; one of the two is missing")
