"""Buckets give the same order, neighbours and quantiles as one global partition would."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelog.functions import order


def test_null_positions_come_first_and_are_not_lost(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a")], "pos long, v string")
    found = order.dense_rank_of_rows(df, ["pos"], order.position_bucket("pos"), "i")
    assert rows(found.select("i", "v")) == [(1, "n"), (2, "a"), (3, "b")]


@pytest.mark.parametrize("width", (1, 3, 1 << 20))
def test_neighbours(spark, width):
    r = [("a", 1, 10), ("b", 2, 20), ("a", 5, None), ("a", 6, 30), (None, 7, 40), ("b", 9, 50)]
    df = spark.createDataFrame(r, "key string, pos long, v long")
    before = order.previous_in_key(df, "v", "w", width=width)
    assert rows(before.where("key is not null").select("key", "pos", "w")) == [("a", 1, None), ("a", 5, 10), ("a", 6, None), ("b", 2, None), ("b", 9, 20)]
    after = order.next_in_key(df, "v", "w", width=width)
    assert rows(after.where("key is not null").select("key", "pos", "w")) == [("a", 1, None), ("a", 5, 30), ("a", 6, None), ("b", 2, 50), ("b", 9, None)]
    assert before.count() == after.count() == len(r)  # a null key keeps its rows


def test_neighbours_in_a_global_order(spark):
    words = [f"k{i * 7 % 100:03d}" for i in range(100)]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "key string, v long")
    bounds = order.range_bounds(df, "key", 5)
    assert bounds == sorted(bounds) and bounds
    found = order.previous_in_order(df, "key", "before", ["key"], order.range_bucket("key", bounds))
    assert rows(found.select("key", "before")) == sorted(zip(sorted(words), [None, *sorted(words)]), key=lambda r: (False, r[0]))


@pytest.mark.parametrize("by", ([], ["name"]))
def test_order_statistics_equal_numpy(spark, by):
    rng = np.random.default_rng(3)
    data = [(n, float(v)) for n, size in (("a", 1), ("b", 2), ("c", 500), (None, 37)) for v in rng.integers(0, 60, size) / 4] + [("c", None)]
    quantiles = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(data, "name string, v double")
    found = order.order_statistics(df, by, "v", quantiles).collect()
    groups = {n for n, _ in data} if by else {None}
    assert len(found) == len(groups)
    for r in found:
        values = [v for n, v in data if v is not None and (not by or n == r["name"])]
        assert [r[q] for q in quantiles] == pytest.approx([np.quantile(values, x) for x in quantiles.values()])
    assert [r["p50"] for r in order.order_statistics(df.limit(0), [], "v", quantiles).collect()] == [None]


def test_no_window_over_a_whole_key(spark):
    """Windows over rows are dealt by bucket too, so a hot key is not one task's."""
    df = spark.createDataFrame([("a", 1, 1)], "key string, pos long, v long").where(F.col("v") > 0)
    plan = order.previous_in_key(df, "v", "w")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("__bucket" in x for x in windows)
