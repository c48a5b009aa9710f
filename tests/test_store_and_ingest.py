"""Ingest parses once into many parts; stores publish after their checks; joins check their right side."""

from __future__ import annotations

import importlib
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from helpers import mart_rows, order, raw_tables
from orderlens.operators import joins, mart as M
from orderlens.operators.joins import JoinCardinalityError, cardinality_errors, left_join_dim
from orderlens.operators.mart import build_order_mart
from orderlens.operators.quality import MartQualityError, check_mart
from orderlens.plans.dashboard import fixture_mart, mart_from, open_mart
from orderlens.schemas import INGEST_COL

from orderlens.sources.mart_store import (
    UnpublishedTableError, frame_key, manifest, materialized, open_published, publish, source_key,
)

C = importlib.import_module("orderlens.sources.csv_tables")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def write(folder, name, body):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(body)
    return path


def sellers_csv(rows, quoted_every=0):
    lines = ["seller_id,seller_city,seller_state"]
    for i in range(rows):
        city = f'"rio\nde, ""{i}"""' if quoted_every and i % quoted_every == 0 else f"city {i}"
        lines.append(f"s{i % 5000},{city},{'NA' if i % 7 == 0 else 'RJ'}")
    return "\n".join(lines) + "\n"


def test_a_large_quoted_file_is_many_parts_after_one_parse(spark, tmp_path, monkeypatch):
    parses = []
    original = C.parsed_text
    monkeypatch.setattr(C, "parsed_text", lambda *a, **k: parses.append(a) or original(*a, **k))
    path = write(tmp_path, "sellers.csv", sellers_csv(40_000, 100))
    table = C.read_csv_table(spark, path, "sellers", part_bytes=100_000)
    assert len(parses) == 1
    text = C.ingest(spark, path, "sellers", part_bytes=100_000)
    assert len(parses) == 1 and table.inputFiles() == text.inputFiles()
    assert all(f.endswith(".parquet") for f in table.inputFiles())
    assert len(table.inputFiles()) >= 8
    rows = table.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and sum(r["count"] for r in rows) == 40_000
    assert table.where("seller_state is null").count() == len(range(0, 40_000, 7))
    assert table.where("seller_city like 'rio\\nde, \"%\"'").count() == 400
    # the place in file order survives: the first row of each key is kept
    first = {r["seller_id"]: r["seller_city"] for r in M.keep_first(table, "seller_id").collect()}
    assert first["s1"] == "city 1" and first["s0"] == 'rio\nde, "0"' and len(first) == 5000


def test_a_plain_file_is_split_and_files_are_scanned_in_one_job(spark, tmp_path):
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    s.conf.set("spark.sql.files.openCostInBytes", "1k")
    write(tmp_path, "a.csv", sellers_csv(20_000))
    write(tmp_path, "b.csv", 'seller_state,"seller_id"\nSP,x1\n')
    write(tmp_path, "c.csv", 'seller_id,seller_city,seller_state\ny1,"a\nb",SP\n')
    files = C.scan_files(s, str(tmp_path))
    assert [(os.path.basename(f["file"]), f["breaks"]) for f in files] == [("a.csv", False), ("b.csv", False), ("c.csv", True)]
    text = C.parsed_text(s, str(tmp_path), "sellers")
    assert text.rdd.getNumPartitions() > 5
    table = C.read_csv_table(s, str(tmp_path), "sellers")
    assert table.count() == 20_002
    got = {r["seller_id"]: (r["seller_city"], r["seller_state"]) for r in table.where("seller_id in ('x1', 'y1')").collect()}
    assert got == {"x1": (None, "SP"), "y1": ("a\nb", "SP")}
    kept = M.keep_first(table, "seller_id").where("seller_id = 's3'").first()
    assert kept["seller_city"] == "city 3"


def test_an_empty_folder_and_a_broken_header_are_named(spark, tmp_path):
    write(tmp_path, "a.csv", "")
    with pytest.raises(ValueError, match="no rows"):
        C.read_csv_table(spark, str(tmp_path), "sellers")
    write(tmp_path, "a.csv", '"seller\nid",seller_state\nx,SP\n')
    with pytest.raises(ValueError, match="line break"):
        C.read_csv_table(spark, str(tmp_path), "sellers")


def test_changed_input_of_the_same_path_is_built_again(spark, tmp_path):
    path = write(tmp_path, "sellers.csv", "seller_id,seller_state\ns1,SP\n")
    assert C.read_csv_table(spark, path, "sellers").count() == 1
    key = source_key(spark, path)
    assert source_key(spark, path) == key
    time.sleep(0.01)
    write(tmp_path, "sellers.csv", "seller_id,seller_state\ns1,SP\ns2,RJ\n")
    assert source_key(spark, path) != key
    assert C.read_csv_table(spark, path, "sellers").count() == 2


def test_a_failed_check_leaves_the_published_table(spark, tmp_path):
    store = str(tmp_path / "mart")
    good = mart_rows(spark, [dict(is_late=0), dict(is_late=1)])
    with pytest.raises(UnpublishedTableError):
        open_published(spark, store)
    publish(good, store, "k1", check_mart)
    with pytest.raises(MartQualityError):
        publish(good.unionByName(good), store, "k2", check_mart)
    assert open_published(spark, store).count() == 2
    assert open_mart(spark, store).count() == 2
    with pytest.raises(UnpublishedTableError):
        open_published(spark, store, "k2")
    publish(good.where("is_late = 1").unionByName(good.withColumn("order_id", F.concat("order_id", F.lit("x")))), store, "k3", check_mart)
    assert open_published(spark, store, "k3").count() == 3
    rows = manifest(spark, store).orderBy("version").collect()
    assert [(r["version"], r["source_key"], r["rows"]) for r in rows] == [(1, "k1", 2), (2, "k3", 3)]


def test_a_plain_folder_is_checked_before_use(spark, tmp_path):
    mart_rows(spark, [dict(is_late=0, order_id="a"), dict(is_late=1, order_id="a")]).write.parquet(str(tmp_path / "m"))
    with pytest.raises(MartQualityError):
        open_mart(spark, str(tmp_path / "m"))


def test_materialized_builds_once_and_by_key(spark):
    calls = []

    def build(n):
        return lambda: calls.append(n) or spark.range(n)

    assert materialized(spark, "t", "a", build(3)).count() == 3
    assert materialized(spark, "t", "a", build(4)).count() == 3
    assert materialized(spark, "t", "b", build(5)).count() == 5
    assert calls == [3, 5]


def test_frame_keys_follow_plan_and_files(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(5).write.parquet(path)
    a = spark.read.parquet(path)
    key = frame_key(a)
    assert key == frame_key(spark.read.parquet(path))
    assert key != frame_key(a.where("id > 1"))
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert key != frame_key(spark.read.parquet(path))


def duplicated(spark):
    return raw_tables(spark, [order("o1"), order("o2", estimated="2018-01-12 00:00:00")],
                      [("o1", 1, "p1", "s1", 5, 1), ("o2", 1, "p1", "s1", 5, 1)],
                      sellers=[("s1", "SP"), ("s1", "RJ"), ("s2", "RJ")])


def test_a_duplicated_right_side_stops_the_mart_build(spark, monkeypatch):
    raw = duplicated(spark)
    assert build_order_mart(raw).count() == 2  # keep-first makes it unique
    monkeypatch.setattr(M, "keep_first", lambda df, key, order_col=INGEST_COL: df.drop(order_col))
    with pytest.raises(JoinCardinalityError, match=r"JOIN_CARDINALITY: sellers.seller_id = s1 has 2 rows"):
        mart_from(spark, lambda: raw, "duplicated sellers")
    with pytest.raises(JoinCardinalityError):  # nothing was published
        mart_from(spark, lambda: raw, "duplicated sellers")


@pytest.mark.parametrize("keys, bad", [(["a", "b"], False), (["a", "a"], True), ([None, None, "a"], True), ([None, "a"], False), (["z", "z"], True)])
def test_cardinality_counts_null_keys_and_keys_that_match_nothing(spark, keys, bad):
    fact = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    dim = spark.createDataFrame([(k, 1) for k in keys], "k string, v int")
    joined = left_join_dim(fact, dim, "k", "dim")
    if bad:
        with pytest.raises(JoinCardinalityError), cardinality_errors():
            joined.collect()
    else:
        assert joined.count() == 3
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # no second scan for the check


def test_other_errors_keep_their_class(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException), cardinality_errors():
        spark.range(1).select(F.raise_error(F.lit("other"))).collect()
    assert joins.NOT_UNIQUE == "JOIN_CARDINALITY"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_build_mart_job_publishes(spark, tmp_path):
    out = str(tmp_path / "mart")
    env = {**os.environ, "ORDERLENS_MASTER": "local[2]", "ORDERLENS_DRIVER_MEMORY": "2g"}
    cmd = [sys.executable, os.path.join(ROOT, "jobs", "build_mart.py"), "--fixture-dir", "/root/testdata/sf0.001", "--out", out]
    subprocess.run(cmd, check=True, env=env, cwd=str(tmp_path), timeout=300, capture_output=True)
    mart = open_mart(spark, out)
    assert mart.count() == fixture_mart(spark, "/root/testdata/sf0.001").count() == 952
