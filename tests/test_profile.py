import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import profile
from cohortlens.sources import synthetic


@pytest.fixture(scope="module")
def data(spark):
    df = synthetic.generate(spark, 300).cache()
    yield df, df.toPandas()
    df.unpersist()


def test_nulls_and_overview(data):
    df, pdf = data
    got = {r["column"]: r["n_nulls"] for r in profile.null_counts(df).collect()}
    assert got == pdf.isnull().sum().to_dict()
    r = profile.overview(df).head()
    assert (r["n_rows"], r["n_columns"], r["null_cells"]) == (300, pdf.shape[1], pdf.isnull().sum().sum())
    assert r["null_pct"] == pytest.approx(100 * pdf.isnull().mean().mean())
    assert profile.null_total(df).head()[0] == pdf.isnull().sum().sum()
    assert profile.null_top(df, 5).count() == 5
    assert profile.null_percent(df, 3).count() == 3


def test_types(data):
    df, _ = data
    assert sum(r["n_columns"] for r in profile.type_histogram(df).collect()) == len(df.columns)


def test_describe_like_pandas(data):
    df, pdf = data
    cols = ["INDE_2020", "IAA_2022", "FASE_2021"]
    want = pdf[cols].astype(float).describe()
    for r in profile.describe(df, cols).collect():
        w = want[r["column"]]
        assert [r["count"], r["mean"], r["std"], r["min"], r["q0_25"], r["q0_5"], r["q0_75"], r["max"]] == pytest.approx(w.tolist())


def test_deviation_of_large_values(spark):
    df = spark.range(1000).select((F.col("id") % 10 + 1e9).alias("x"))
    assert profile.describe(df, ["x"]).head()["std"] == pytest.approx(float(np.std([i % 10 for i in range(1000)], ddof=1)))


def test_correlations(data):
    df, pdf = data
    cols = ["INDE_2020", "IAA_2020", "DEFASAGEM_2020"]
    want = pdf[cols].astype(float).corr()
    for r in profile.correlation_matrix(df, cols).collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]])
    assert profile.correlation_matrix(df, cols).count() == 9
    top = profile.top_pairs(df, cols, 1).head()
    assert top["corr"] == pytest.approx(max(want.iloc[0, 1], want.iloc[0, 2], want.iloc[1, 2]))
    with pytest.raises(ValueError):
        profile.correlations(df, ["INDE_2020"])


def test_correlations_in_blocks(data, monkeypatch):
    df, _ = data
    cols = [f"{s}_2020" for s in ("INDE", "IAA", "IEG", "IPS")]
    whole = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(df, cols).collect()}
    monkeypatch.setattr(profile, "PAIRS", 2)
    assert {(r["a"], r["b"]): r["corr"] for r in profile.correlations(df, cols).collect()} == pytest.approx(whole)


def test_histogram(data):
    df, pdf = data
    want, edges = np.histogram(pdf["INDE_2020"].dropna(), bins=25)
    got = {r["bin"]: (r["n"], r["low"]) for r in profile.histogram(df, ["INDE_2020"], 25).collect()}
    assert sum(n for n, _ in got.values()) == want.sum()
    for b, (n, low) in got.items():
        assert abs(n - want[b]) <= 1 and low == pytest.approx(edges[b])


def test_constant_column_has_one_bin(frame):
    rows = profile.histogram(frame("x double", (2.0,), (2.0,)), ["x"], 10).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2)]


def test_box(frame):
    df = frame("x double, g string", *[(float(v), "a") for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], (5.0, "b"))
    r = {x["g"]: x for x in profile.box_stats(df, ["x"], ["g"]).collect()}
    a = r["a"]
    assert (a["q1"], a["median"], a["q3"]) == pytest.approx(tuple(np.quantile([1, 2, 3, 4, 5, 6, 7, 8, 9, 100], [0.25, 0.5, 0.75])))
    assert (a["low_whisker"], a["high_whisker"], a["n_outliers"], a["max"]) == (1.0, 9.0, 1, 100.0)
    assert r["b"]["n_outliers"] == 0
    out = profile.box_outliers(df.where("g = 'a'").withColumn("k", F.lit(1)), ["x"], ["k"]).collect()
    assert [x["value"] for x in out] == [100.0]


def test_counts(frame):
    df = frame("c string, d int", ("x", 1), ("x", 2), ("y", 2), (None, 2))
    assert [(r["value"], r["n"]) for r in profile.category_counts(df, "c").collect()] == [("x", 2), ("y", 1)]
    got = {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, ["c", "d"]).collect()}
    assert got == {"c": 2, "d": 2}
    assert {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, ["c", "d"], approximate=True).collect()} == got
