"""Helpers shared by the operators: shared-folder tables, narrow inputs, row ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orderlens.config import checkpoint_root


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage: what follows rereads files every executor can see, and a
    non-deterministic column (row id) is fixed from here on.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name.

    The key is the row's place in the scan. It is the same in every job over the same
    stored table of a session, also when an executor is lost; results of shuffles
    must be written first.
    """
    name = free_name(docs, "_row")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def row_ranges(off: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``max_bytes`` (one longer row makes a range alone)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
