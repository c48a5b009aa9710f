"""CSV catalog of the raw order tables: ingest into Parquet, explicit types, pandas-compatible nulls.

Ingest reads the lines of all files of a table once, in one distributed scan, for each
file's header and for quoted line breaks; the driver gets a row per file. Files are
then parsed once, all files of one header together: files without quoted line breaks
in splits, the others by one task a file, whose rows are dealt to many tasks right
after. The cells go to Parquet as text with their place in file order; type checks, null
tokens and all later jobs read that Parquet.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.columns import na_to_null
from orderlens.schemas import CSV_EXTRA_TYPES, DATA_FILES, INGEST_COL, KEEP_FIRST_KEYS, RAW_COLUMNS
from orderlens.sources.mart_store import materialized, source_key
from orderlens.sources.tables import RawTables

# Bytes of a file with quoted line breaks per task after it is parsed.
PART_BYTES = 64 << 20


def _csv_pos() -> F.Column:
    """File order of a CSV row: file, split start, then the id (increasing within a split)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


class CsvCellError(ValueError):
    """Cells of a raw table that are neither missing nor of their column's type."""


def scan_files(spark: SparkSession, path: str) -> list:
    """A row per file: path, first line, whether a quoted cell holds a line break, bytes.

    A line with an odd number of quotes opens or closes a cell that goes on in
    another line. Empty files give no row.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(
        F.min_by("value", "at").alias("header"), F.max(quotes % 2 == 1).alias("breaks"),
        F.max("bytes").alias("bytes")).orderBy("file").collect()


def _columns(file: str, header: str) -> tuple[str, ...]:
    if header.count('"') % 2:
        raise ValueError(f"{file}: the header holds a line break")
    return tuple(next(csv.reader([header.lstrip("﻿")])))


def parsed_text(spark: SparkSession, path: str, name: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every cell of a raw table as text, plus its place in file order where keep-first needs it.

    Files are read by header, one group per column order, so a file with another
    order keeps its cells under their names. Rows with more or fewer cells than the
    header fail the read.
    """
    groups: dict[tuple, list] = {}
    for f in scan_files(spark, path):
        groups.setdefault((_columns(f["file"], f["header"]), f["breaks"]), []).append(f)
    if not groups:
        raise ValueError(f"{path}: no rows")
    texts = []
    for (columns, breaks), files in groups.items():
        missing = [c for c in RAW_COLUMNS[name] if c not in columns]
        if missing:
            raise ValueError(f"{files[0]['file']}: missing columns {missing}")
        reader = (
            spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
            .option("header", True).option("enforceSchema", False).option("encoding", "UTF-8")
            .option("quote", '"').option("escape", '"').option("multiLine", breaks).option("mode", "FAILFAST")
        )
        part = reader.csv([f["file"] for f in files])
        if name in KEEP_FIRST_KEYS:
            part = part.select("*", _csv_pos().alias(INGEST_COL))
        parts = -(-sum(f["bytes"] for f in files) // part_bytes)
        texts.append(part.repartition(parts) if breaks and parts > len(files) else part)
    df = texts[0]
    for part in texts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df


def ingest(spark: SparkSession, path: str, name: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The table's cells as text in Parquet, written once per state of its files."""
    return materialized(spark, f"csv-{name}", source_key(spark, path), lambda: parsed_text(spark, path, name, part_bytes))


def read_csv_table(spark: SparkSession, path: str, name: str, on_bad_cell: str = "raise",
                   part_bytes: int = PART_BYTES) -> DataFrame:
    """One raw table from its ingested Parquet: NA tokens to null, then typed.

    Quoted line breaks stay inside their row. Cells that do not parse as their type
    raise ``CsvCellError`` with their count per column; ``on_bad_cell="null"`` makes
    them null instead.
    """
    df = ingest(spark, path, name, part_bytes)
    types: dict[str, T.DataType] = {**RAW_COLUMNS[name], **CSV_EXTRA_TYPES.get(name, {})}
    cols, bad = [], []
    for c in df.columns:
        target = types.get(c, T.StringType())
        if c == INGEST_COL:
            cols.append(F.col(c))
            continue
        cell = na_to_null(F.col(f"`{c}`"))
        if isinstance(target, T.StringType):
            cols.append(cell.alias(c))
            continue
        typed = cell.try_cast(target)
        exact = typed.isNotNull()
        if isinstance(target, T.DecimalType):
            wide = cell.try_cast(T.DecimalType(38, 18))
            exact = exact & (typed.cast(T.DecimalType(38, 18)) == wide)
        bad.append(F.count_if(cell.isNotNull() & ~F.coalesce(exact, F.lit(False))).alias(c))
        cols.append(typed.alias(c))
    if bad and on_bad_cell == "raise":
        wrong = {c: n for c, n in df.agg(*bad).first().asDict().items() if n}
        if wrong:
            raise CsvCellError(f"{path}: cells that do not fit their type, by column: {wrong}")
    return df.select(*cols)


def table_paths(data_dir: str, files: Mapping[str, str] = DATA_FILES) -> dict[str, str]:
    """The path of each of the eight tables (files, globs or folders)."""
    return {name: f"{data_dir.rstrip('/')}/{fname}" for name, fname in files.items()}


def csv_tables(spark: SparkSession, data_dir: str, files: Mapping[str, str] = DATA_FILES) -> RawTables:
    """The eight raw tables of ``data_dir``, ingested into Parquet."""
    tables = RawTables(**{name: read_csv_table(spark, path, name) for name, path in table_paths(data_dir, files).items()})
    tables.validate()
    return tables
