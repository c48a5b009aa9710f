"""Tables that are built once per state of their sources, checked, and only then published.

A store is a folder: ``data/<id>`` holds a written table, ``manifest`` holds a row per
published table. A build writes a new ``data`` folder, checks what it reads back from it, and
adds the manifest row last, so readers see the old table until the new one has
passed, and for good if it fails. One writer at a time is assumed. Reading Parquet back also
cuts the lineage of the build: a lost executor later costs a re-read, not the joins.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.config import checkpoint_root, sized_tasks

_LOCK = threading.Lock()
_OPENED: dict[str, tuple[str, T.StructType]] = {}
_MANIFEST = "version long, data string, source_key string, rows long, published timestamp"


class UnpublishedTableError(FileNotFoundError):
    """A store that holds no published table."""


def _app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


def source_key(spark: SparkSession, *paths: str) -> str:
    """Identity of input files: a digest over path, size and modification time of each.

    The listing runs in Spark without reading the files; 16 bytes a file come back.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    of = ["path", "length", F.unix_micros("modificationTime")]
    marks = sorted(files.select(F.xxhash64(*of), F.xxhash64(F.lit("second"), *of)).collect())
    return f"{len(marks)}:{hashlib.sha256(repr([tuple(m) for m in marks]).encode()).hexdigest()}"


def source_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of input files, from their listing."""
    if not paths:
        return 0
    return spark.read.format("binaryFile").load(list(paths)).agg(F.sum("length")).first()[0] or 0


def frame_key(df: DataFrame) -> str:
    """Identity of a DataFrame: its plan, and the files it reads."""
    files = df.inputFiles()
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString() if not files else ""
    return f"{df.semanticHash()}:{hashlib.sha256(plan.encode()).hexdigest()[:16]}:" + (
        source_key(df.sparkSession, *files) if files else "")


def store_path(spark: SparkSession, kind: str, key: str) -> str:
    """Folder of a store of this application inside the shared folder."""
    digest = hashlib.sha1(f"{_app_id(spark)}|{kind}|{key}".encode()).hexdigest()[:16]
    return f"{checkpoint_root(spark)}/orderlens/{kind}/{digest}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` under a fresh path of the shared folder and read it back."""
    path = store_path(df.sparkSession, kind, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """The published versions of a store, None if there are none."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{store}/manifest")
    except AnalysisException:
        return None


def _latest(spark: SparkSession, store: str):
    rows = manifest(spark, store)
    return None if rows is None else rows.orderBy(F.desc("version")).limit(1).collect()


def publish(df: DataFrame, store: str, key: str, check: Callable[[DataFrame], None] | None = None,
            partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` into a new data folder of ``store``, check it there, then make it the published version.

    The tasks of the build are sized by the files it reads.
    """
    spark = df.sparkSession
    last = _latest(spark, store)
    version = last[0]["version"] + 1 if last else 1
    data = f"data/{version:06d}-{uuid.uuid4().hex}"
    with sized_tasks(spark, source_bytes(spark, *df.inputFiles())):
        df.write.partitionBy(*partition_by).parquet(f"{store}/{data}")
    table = spark.read.parquet(f"{store}/{data}")
    if check is not None:
        check(table)
    row = spark.createDataFrame([(version, data, key)], "version long, data string, source_key string")
    row = row.withColumns({"rows": F.lit(table.count()).cast("long"), "published": F.current_timestamp()})
    row.coalesce(1).write.mode("append").json(f"{store}/manifest")
    return table


def published_path(spark: SparkSession, store: str, key: str | None = None) -> str:
    """The data folder that ``store`` publishes; with ``key``, only if it was built from that state of its sources."""
    last = _latest(spark, store)
    if not last or (key is not None and last[0]["source_key"] != key):
        raise UnpublishedTableError(f"{store}: no published table")
    return f"{store}/{last[0]['data']}"


def open_published(spark: SparkSession, store: str, key: str | None = None) -> DataFrame:
    """The published table of ``store``."""
    return spark.read.parquet(published_path(spark, store, key))


def materialized(
    spark: SparkSession,
    kind: str,
    key: str,
    build: Callable[[], DataFrame],
    check: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """The table ``kind`` for the state ``key`` of its sources; built, checked and published on first use."""
    store = store_path(spark, kind, key)
    with _LOCK:
        if store not in _OPENED:
            try:
                path = published_path(spark, store, key)
            except UnpublishedTableError:
                publish(build(), store, key, check)
                path = published_path(spark, store, key)
            # published data folders never change: later calls skip the manifest and the footers
            _OPENED[store] = path, spark.read.parquet(path).schema
        path, schema = _OPENED[store]
    return spark.read.schema(schema).parquet(path)
