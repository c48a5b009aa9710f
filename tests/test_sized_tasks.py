"""Builds whose tasks are sized by the files they read."""

from __future__ import annotations

import os
from functools import partial

import pytest

from orderlens import config
from orderlens.sources import mart_store

NAMES = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]


def test_settings_are_made_finer_only_and_come_back(spark):
    before = [spark.conf.get(c) for c in NAMES]
    with config.sized_tasks(spark, 100 << 20, 1 << 20):
        assert [spark.conf.get(c) for c in NAMES] == ["100", "1048576b", "1048576b"]
        with config.sized_tasks(spark, 10 << 20, 1 << 20):
            assert spark.conf.get(NAMES[0]) == "100"
    with pytest.raises(ValueError), config.sized_tasks(spark, 100 << 20):
        raise ValueError
    assert [spark.conf.get(c) for c in NAMES] == before


def test_a_build_gets_more_partitions_with_more_input(spark, tmp_path, monkeypatch):
    """With two partitions set, a published grouping of 400 kB is dealt to at least twenty."""
    spark.range(100_000).repartition(4).write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(mart_store, "sized_tasks", partial(config.sized_tasks, task_bytes=10_000))
    joining = "spark.sql.adaptive.coalescePartitions.enabled"  # off, so that the files show the partitions
    before = spark.conf.get(NAMES[0])
    spark.conf.set(NAMES[0], "2")
    spark.conf.set(joining, "false")
    try:
        out = mart_store.publish(spark.read.parquet(str(tmp_path / "in")).groupBy("id").count(), str(tmp_path / "store"), "k")
        assert spark.conf.get(NAMES[0]) == "2"
    finally:
        spark.conf.set(NAMES[0], before)
        spark.conf.unset(joining)
    assert out.count() == 100_000
    assert len(out.inputFiles()) >= 20
    assert sum(os.path.getsize(f"{tmp_path}/in/{f}") for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")) == (
        mart_store.source_bytes(spark, str(tmp_path / "in")))
