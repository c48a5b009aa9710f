"""Exact order statistics against brute force (numpy), including ties and tiny groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.functions import aggregates
from orderlens.ml import evaluate
from orderlens.functions.aggregates import exact_median, mode_or_unknown, ordered_bits, values_at_ranks


@pytest.mark.parametrize("n,distinct", [(1, 1), (2, 2), (7, 3), (1000, 1000), (5001, 40), (20000, 20000)])
def test_exact_median_matches_numpy(spark, n, distinct):
    rng = np.random.default_rng(n)
    vals = rng.integers(0, distinct, size=n).astype(float) * 0.37
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    got = exact_median(df, "x").first()
    assert got["n"] == n
    assert got["median"] == pytest.approx(float(np.median(vals)), abs=1e-12)


def test_exact_median_skips_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,), (None,)], "x double")
    assert exact_median(df, "x").first()["median"] == 2.0
    empty = spark.createDataFrame([], "x double")
    assert exact_median(empty, "x").count() == 0


def test_hot_value_holding_a_third(spark):
    vals = [5.0] * 3000 + [float(i) for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(8)
    assert exact_median(df, "x").first()["median"] == float(np.median(vals))


def test_ranks_per_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 2, 30000), rng.normal(size=30000))]
    rows += [(None, 4.0), (None, -4.0), (None, 1e300), (5, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = values_at_ranks(df, "v", {"k": lambda n: n - (n + 4) // 5 - 1, "first": lambda n: 0, "out": lambda n: n}, groups=["g"])
    by_group = {r["g"]: r for r in got.collect()}
    assert set(by_group) == {0, 1, None}
    for g, r in by_group.items():
        vals = np.sort([v for h, v in rows if h == g])
        n = len(vals)
        assert (r["n"], r["first"], r["out"]) == (n, vals[0], None)
        assert r["k"] == vals[n - (n + 4) // 5 - 1]


@pytest.mark.parametrize("values, kind", [
    ([-(1 << 63), (1 << 63) - 1, 0, -1, 1, 5, 5], "bigint"),
    ([0.0, -0.0, 1e-320, -1e-320, 1.7e308, -1.7e308, 0.5, 0.5000000000000001], "double"),
    ([float("inf"), float("-inf"), 1.0], "double"),
    ([3, -3, 3, 3], "int"),
])
def test_every_rank_of_extreme_values(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values + [None]], f"x {kind}").repartition(3)
    ranks = {f"r{k}": (lambda n, k=k: k) for k in range(len(values))}
    row = values_at_ranks(df, "x", ranks).first()
    assert [row[f"r{k}"] for k in range(len(values))] == sorted(values)


def test_ordered_bits_keep_the_order(spark):
    values = sorted([0.1 * k for k in range(-500, 500)] + [1e300, -1e300, 5e-324, -5e-324, 2.0**60, 2.0**60 + 256])
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bits = [r[0] for r in df.orderBy("x").select(ordered_bits(F.col("x"), df.schema["x"].dataType)).collect()]
    assert bits == sorted(bits) and len(set(bits)) == len(set(values))


def test_four_million_rows_move_only_counts(spark, monkeypatch):
    """Skewed values, two thirds in a sliver: exact, with few scans and a bounded number of rows after each."""
    passes = []
    original = aggregates.range_counts
    monkeypatch.setattr(aggregates, "range_counts", lambda v, r: passes.append(original(v, r)) or passes[-1])
    n = 4_000_000
    k = F.col("id")
    x = F.when(k % 3 == 0, 7.25).when(k % 3 == 1, 7.0 + (k % 1_000_003) * 1e-9).otherwise((k * 7919 % n) * 0.37 - 1e5)
    df = spark.range(0, n, 1, 8).select(x.alias("x"))
    row = exact_median(df, "x").first()
    ids = np.arange(n)
    xs = np.where(ids % 3 == 0, 7.25, np.where(ids % 3 == 1, 7.0 + (ids % 1_000_003) * 1e-9, (ids * 7919 % n) * 0.37 - 1e5))
    assert row["n"] == n and row["median"] == float(np.median(xs))
    assert 1 <= len(passes) <= 5
    assert passes[0].count() <= 2 * aggregates.RANGES
    for p in passes:
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") >= 2 and "SortMergeJoin" not in plan and "Sort " not in plan


def test_mode_or_unknown(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, None), (2, "z"), (3, None)], "k int, v string")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(mode_or_unknown("v").alias("m")).collect()}
    assert got == {1: "a", 2: "z", 3: "Unknown"}


def test_auc_of_scores_in_a_sliver_is_spread_over_tasks(spark):
    n = 200_000
    k = F.col("id")
    pred = spark.range(0, n, 1, 8).select(
        (F.lit(0.5) + (k * 7919 % n) * (0.001 / n)).alias("score"), ((k * 31 + k % 7) % 5 == 0).cast("int").alias("label"))
    spread = evaluate.score_ranges(pred).groupBy("_range").count().collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spread) == parts
    assert max(r["count"] for r in spread) < 2 * n / parts
    rows = pred.collect()
    scores, labels = np.array([r["score"] for r in rows]), np.array([r["label"] for r in rows])
    order = np.argsort(scores)
    below = np.cumsum(labels[order] == 0)
    want = below[labels[order] == 1].sum() / ((labels == 1).sum() * (labels == 0).sum())
    assert evaluate.roc_auc(pred).first()["roc_auc"] == pytest.approx(want, abs=1e-12)
