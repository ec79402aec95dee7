"""NaN is null in every statistic, and missing predictions or scores are left out by one rule."""

import math

import pytest

from cohortlens.operators import evaluate, impute, profile, scale, target

NAN = float("nan")


def test_null_profile_counts_nan(frame):
    df = frame("a double, b string", (NAN, "x"), (None, None), (1.0, "NaN"))
    assert {r["column"]: r["n_nulls"] for r in profile.null_counts(df).collect()} == {"a": 2, "b": 1}


def test_scale_and_correlation_leave_nan_out(frame):
    df = frame("a double, b double, c double", (1.0, 2.0, 1.0), (2.0, 4.0, NAN), (3.0, 6.0, 5.0), (NAN, 1.0, 2.0))
    stats = {r["column"]: r for r in scale.fit(df, ["a"]).collect()}
    assert stats["a"]["mean"] == 2.0 and stats["a"]["std"] == pytest.approx(math.sqrt(2 / 3))
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] == pytest.approx(1.0)


def test_correlations_of_many_columns_take_one_scan(spark):
    columns = [f"c{i}" for i in range(92)]
    df = spark.range(200).selectExpr(*[f"cast(pmod(xxhash64(id, {i}), 100) AS double) AS c{i}" for i in range(92)])
    made = profile.correlations(df, columns)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 200") == 1 and made.count() == 92 * 91 // 2
    import numpy as np

    x = np.array([list(r) for r in df.collect()])
    want = np.corrcoef(x.T)
    assert all(r["corr"] == pytest.approx(want[int(r["a"][1:]), int(r["b"][1:])]) for r in made.limit(300).collect())


def test_group_medians_fill_nan_and_rows_without_group(frame):
    df = frame("k int, g string, v double", (1, "x", 1.0), (2, "x", 3.0), (3, "x", NAN), (4, None, 7.0), (5, None, None))
    got = {r["k"]: r["v"] for r in impute.fitted_by_group(df, "g", ["v"]).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: 7.0, 5: 7.0}


def test_evaluation_has_the_rules_of_its_parts(frame):
    df = frame("y int, p int, s double", (1, 1, 0.9), (0, 0, 0.1), (1, None, 0.8), (1, 1, None), (0, 0, NAN), (None, 1, 0.5))
    whole = evaluate.evaluation(df, "y", "p", "s", "m").head()
    parts = evaluate.binary_metrics(df.where("y IS NOT NULL"), "y", "p").head()
    assert (whole["recall"], whole["accuracy"], whole["n_test_samples"]) == (parts["recall"], parts["accuracy"], 4) == (1.0, 1.0, 4)
    assert whole["auc_roc"] == 1.0
    plain = evaluate.evaluation(df, "y", "p", None, "m").head()
    assert plain["auc_roc"] is None and plain["true_positives"] == 2


def test_labels_must_be_labels(frame):
    with pytest.raises(Exception, match="not 0 or 1"):
        target.binarize(frame("d int", (-1,), (0,)), "d", "already_binary").collect()


def test_all_columns_at_once(frame):
    df = frame("k int, a double, b string", (1, 1.0, "x"), (2, NAN, "x"), (3, 3.0, None))
    got = [tuple(r) for r in impute.impute_all(df, keep=("k",)).orderBy("k").collect()]
    assert got == [(1, 1.0, "x"), (2, 2.0, "x"), (3, 3.0, "x")]
    assert [r["k"] for r in impute.impute_all(df, "drop", ("k",)).collect()] == [1]
