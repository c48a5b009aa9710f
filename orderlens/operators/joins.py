"""Dimension joins with pandas' rule that a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JoinCardinalityError(RuntimeError):
    """The right side of a many-to-one join holds a key more than once."""


NOT_UNIQUE = "JOIN_CARDINALITY"


@contextmanager
def cardinality_errors() -> Iterator[None]:
    """Jobs run inside that fail on a repeated key raise ``JoinCardinalityError`` with its table, key and count."""
    try:
        yield
    except PySparkException as e:
        found = str(e).find(NOT_UNIQUE)
        if found < 0:
            raise
        raise JoinCardinalityError(str(e)[found:].splitlines()[0]) from e


def one_row_each(dim: DataFrame, key: str, name: str) -> DataFrame:
    """``dim`` unchanged; a key with more rows than one (null counts as a key) fails the job that reads it.

    Counted while the rows are grouped by key, after partial aggregation: no
    second scan, and none of the rows is dropped unseen.
    """
    attrs = [c for c in dim.columns if c != key]
    rows = dim.groupBy(key).agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in attrs])
    message = F.format_string(f"{NOT_UNIQUE}: {name}.{key} = %s has %d rows", F.col(key).cast("string"), F.col("_rows"))
    checked = F.when(F.col("_rows") == 1, F.col(key)).otherwise(F.raise_error(message).cast(dim.schema[key].dataType))
    return rows.select(checked.alias(key), *attrs).select(*dim.columns)


def left_join_dim(fact: DataFrame, dim: DataFrame, key: str, name: str = "right side") -> DataFrame:
    """``fact`` LEFT JOIN ``dim`` ON ``key`` where a null key matches the null-key row.

    Many to one: a key of ``dim`` (called ``name``) with more than one row fails
    the job. The null-safe condition hashes both sides anew, so the grouping of
    ``dim`` by its key is not reused: both inputs of a sort-merge join are plain
    shuffles, which AQE can split when one key holds a large share of the rows.
    Whether ``dim`` is broadcast is left to the planner's and AQE's byte thresholds.
    """
    attrs = [c for c in dim.columns if c != key]
    right = one_row_each(dim, key, name).withColumnRenamed(key, "_dim_key")
    joined = fact.join(right, F.col(key).eqNullSafe(F.col("_dim_key")), "left")
    return joined.select(*fact.columns, *attrs)
