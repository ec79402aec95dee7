"""Running sums, quantiles and splits against brute force, on skewed data and under any partitioning."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import ranks, split


def skewed(spark, n=20000):
    """A third of the rows share one value, and one key holds most rows."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else f"k{i % 3}", 5.0 if rng.random() < 0.34 else round(rng.gauss(0, 100), 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_prefix_sums_against_numpy(spark):
    rows, df = skewed(spark)
    got = ranks.prefix_sums(ranks.value_counts(df, ["k"], "v"), ["k"], "v", ["n"], next_value=True).toPandas()
    for key in {r[0] for r in rows}:
        values, counts = np.unique([v for k, v in rows if k == key], return_counts=True)
        part = got[got.k == key].sort_values("v")
        assert part.v.tolist() == values.tolist()
        assert part.cum_n.tolist() == counts.cumsum().tolist()
        assert set(part.tot_n) == {counts.sum()}
        assert part.next_value.tolist()[:-1] == values.tolist()[1:] and np.isnan(part.next_value.tolist()[-1])


def test_hot_key_is_spread_over_ranges(spark):
    _, df = skewed(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so little data is one range
    try:
        ranged = ranks.in_ranges(ranks.value_counts(df, ["k"], "v"), ["k"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranged.where("k = 'hot'").groupBy("_range").count().collect()]
    assert len(sizes) >= parts - 1 and max(sizes) < 1.5 * sum(sizes) / len(sizes)
    bounds = ranged.where("k = 'hot'").groupBy("_range").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_range").collect()
    assert all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_quantiles_do_not_depend_on_partitioning(spark, parts):
    rows, df = skewed(spark, 5000)
    got = ranks.quantiles(df.repartition(parts), ["k"], "v", [0.1, 0.25, 0.5, 0.99]).collect()
    for r in got:
        want = np.quantile([v for k, v in rows if k == r["k"]], [0.1, 0.25, 0.5, 0.99])
        assert np.allclose([r["q0_1"], r["q0_25"], r["q0_5"], r["q0_99"]], want)


def test_unbounded_keys_join_without_a_forced_broadcast(spark):
    rows, df = skewed(spark, 2000)
    got = {r["k"]: r["q0_5"] for r in ranks.quantiles(df, ["k"], "v", [0.5], few_keys=False).collect()}
    assert got == pytest.approx({k: np.median([v for x, v in rows if x == k]) for k in got})


def test_no_window_over_all_rows(spark):
    _, df = skewed(spark, 1000)
    plan = ranks.prefix_sums(ranks.value_counts(df, [], "v"), [], "v", ["n"])._jdf.queryExecution().executedPlan().toString()
    running = [line for line in plan.splitlines() if "Window [sum" in line and "v#" in line]
    assert running and all("_range" in line for line in running)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_median_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ranks.quantiles(df, [], "v", [0.5]).head()[0] == pytest.approx(float(np.median(values)), abs=1e-6)


def labelled(spark, zeros, ones):
    rows = [(i, 0) for i in range(zeros)] + [(zeros + i, 1) for i in range(ones)]
    return spark.createDataFrame(rows, "k bigint, y int")


def counts(df, part):
    return {(r["y"], r[part]): r["count"] for r in df.groupBy("y", part).count().collect()}


@pytest.mark.parametrize("zeros,ones", [(50, 50), (70, 30), (1000, 333), (3, 1)])
def test_split_sizes_are_exact(spark, zeros, ones):
    got = counts(split.stratified(labelled(spark, zeros, ones), "y", "k"), "split")
    for label, n in ((0, zeros), (1, ones)):
        test = int(0.2 * n + 0.5)
        assert got.get((label, "test"), 0) == test and got.get((label, "train"), 0) == n - test


def test_split_follows_the_hash_order(spark):
    out = split.stratified(labelled(spark, 60, 40), "y", "k").collect()
    for label in (0, 1):
        keys = sorted((r["k"] for r in out if r["y"] == label), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
        test = {r["k"] for r in out if r["y"] == label and r["split"] == "test"}
        assert test == set(keys[: len(test)])


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_split_does_not_depend_on_partitioning(spark, parts):
    df = labelled(spark, 120, 45)
    a = split.stratified(df, "y", "k")
    b = split.stratified(df.repartition(parts), "y", "k")
    assert a.exceptAll(b).count() == 0


def test_seed_changes_the_split(spark):
    df = labelled(spark, 200, 100)
    assert split.stratified(df, "y", "k", seed=1).exceptAll(split.stratified(df, "y", "k", seed=2)).count() > 0


@pytest.mark.parametrize("zeros,ones", [(103, 52), (5, 5), (7, 2)])
def test_folds(spark, zeros, ones):
    out = split.folds(labelled(spark, zeros, ones), "y", "k", 5)
    found = counts(out, "fold")
    for label, n in ((0, zeros), (1, ones)):
        sizes = [found.get((label, f), 0) for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_rows_are_not_shuffled_by_a_split(spark):
    plan = split.stratified(labelled(spark, 50, 50), "y", "k")._jdf.queryExecution().executedPlan().toString()
    head = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in head.replace("BroadcastExchange", "")


def test_hash_split_is_about_right(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    share = split.by_hash(df, "k").where("split = 'test'").count() / 20000
    assert abs(share - 0.2) < 0.02


@pytest.mark.parametrize("n,distinct", [(5, 5), (300, 7), (30_000, 25_000), (30_000, 3)])
def test_bracketed_quantiles_are_exact(spark, n, distinct):
    import numpy as np

    df = spark.range(n).selectExpr("id % 3 AS k", f"cast(pmod(xxhash64(id), {distinct}) AS double) / 7 AS v")
    probabilities = [0.0, 0.0004, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = {r["k"]: list(r)[1:] for r in ranks.quantiles(df, ["k"], "v", probabilities).collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["v"])
    assert {k: pytest.approx(list(np.quantile(v, probabilities))) for k, v in values.items()} == got
    plan = ranks.quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0" not in plan  # the last job ranks what is inside the brackets only
