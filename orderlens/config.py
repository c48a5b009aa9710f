"""Session settings and the shared checkpoint folder.

Cluster jobs get their session from spark-submit; ``get_session`` only fills in
settings that are not already set, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from measured shuffle sizes
# (broadcast conversion, skew splitting, partition coalescing); the session
# zone is UTC because source timestamps carry no zone.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def get_session(
    master: str | None = None,
    app_name: str = "orderlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session or build one with the defaults above."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
            builder = builder.config("spark.driver.memory", os.environ.get("ORDERLENS_DRIVER_MEMORY", "16g"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Input bytes (Parquet) that a scan task and, on average, a shuffle partition of a wide build handles at most.
TASK_BYTES = 16 << 20
_PARTITIONS = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
_SIZES = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]


@contextmanager
def sized_tasks(spark: SparkSession, input_bytes: int, task_bytes: int = TASK_BYTES) -> Iterator[None]:
    """Jobs inside get tasks whose rows fit in memory, however large the input; settings that are finer already stay.

    Without it a fixed number of partitions, or wide scan splits, hold more rows with every row
    of the input, until sorts and partial aggregates spill all of them.
    """
    def size(name: str) -> int:
        number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", spark.conf.get(name).strip().lower()).groups()
        return int(number) << 10 * " kmgtp".index(unit or " ")

    needed = -(-input_bytes // task_bytes)
    finer = {c: str(needed) for c in _PARTITIONS if int(spark.conf.get(c, None) or needed) < needed}
    finer |= {c: f"{task_bytes}b" for c in _SIZES if size(c) > task_bytes}
    before = {c: spark.conf.get(c) for c in finer}
    for c, value in finer.items():
        spark.conf.set(c, value)
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs inside send Python workers Arrow batches of about ``size`` bytes at most; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables and checkpoints.

    Uses ``spark.checkpoint.dir`` (or a directory already set on the context).
    Only a local-mode session may do without: it takes a folder of the
    warehouse. A cluster job without the setting fails.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    root = configured or current
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running orderlens jobs")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_orderlens"
    if not current:
        sc.setCheckpointDir(root)
    return root.rstrip("/")
