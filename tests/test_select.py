import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import gram, impute, profile, ranks, select


def exact(values, probabilities):
    return [float(np.quantile(np.array(values), p)) if values else None for p in probabilities]


P = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns_of(kind, n, rng):
    make = {
        "uniform": lambda: rng.uniform(0, 10), "normal": lambda: rng.gauss(0, 1), "few": lambda: float(rng.randrange(5)), "signs": lambda: rng.choice([-1.0, 1.0]) * rng.random() ** 9,
        "sizes": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "far": lambda: 1e15 + rng.randrange(1000), "tiny": lambda: rng.randrange(40) * 5e-324,
        "gaps": lambda: None if rng.random() < 0.7 else rng.random(), "ends": lambda: rng.choice([0.0, -0.0, 1e308, -1e308, 5e-324, math.inf, -math.inf]),
    }
    return [make[kind]() for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_quantiles_are_exact_for_values_of_any_size(spark, n):
    rng = random.Random(n)
    kinds = ["uniform", "normal", "few", "signs", "sizes", "far", "tiny", "gaps"]
    data = {k: columns_of(k, n, rng) for k in kinds}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{k} double" for k in kinds)).withColumn("none", F.lit(None).cast("double")).withColumn("a.b", F.col("few")).repartition(5)
    found, moments = select.order_statistics(df, [*kinds, "none", "a.b"], P)
    for k, q, m in zip(kinds, found, moments):
        values = sorted(v for v in data[k] if v is not None)
        assert q == (pytest.approx(exact(values, P), rel=1e-12, abs=1e-323) if values else [None] * len(P)), k
        assert (m.n, m.low, m.high) == (len(values), *( (values[0], values[-1]) if values else (None, None)))
        if k in ("uniform", "normal", "few", "far") and len(values) > 1:
            assert (m.mean, m.std) == pytest.approx((np.mean(values), np.std(values, ddof=1)), rel=1e-3 if k == "far" else 1e-9)
    assert found[-2] == [None] * len(P) and found[-1] == found[kinds.index("few")]


def test_ends_of_the_doubles_and_nan(spark):
    data = sorted(columns_of("ends", 501, random.Random(1)))
    df = spark.createDataFrame([(v,) for v in [*data, math.nan, None]], "x double")
    found, moments = select.order_statistics(df, ["x"], [i / 500 for i in range(501)])
    assert moments[0].n == 501
    # between equal infinities there is nothing to interpolate
    assert [q for q, v in zip(found[0], data) if math.isfinite(v)] == [v for v in data if math.isfinite(v)]


def test_a_pass_sends_counts_only(spark):
    df = spark.range(10_000).select((F.col("id") * 0.37 % 11).alias("x"), (F.col("id") % 3).alias("y"))
    seen = []
    original = select._entries

    def watched(rows, cells):
        out = original(rows, cells)
        seen.append(len(cells))
        return out

    select._entries = watched
    try:
        select.order_statistics(df, ["x", "y"], [0.25, 0.5, 0.75])
    finally:
        select._entries = original
    assert 2 <= len(seen) <= 6 and seen[0] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y int")
    assert select.order_statistics(df, ["x", "y"], [0.5])[0] == [[None], [None]]
    assert impute.medians(df, ["x", "y"]).count() == 0 and profile.describe(df, ["x"]).count() == 0 and profile.box_stats(df, ["x"]).count() == 0


def test_a_wrong_bracket_is_noticed_and_mended(spark, monkeypatch):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.sqrt("id").alias("v"))
    want = {r["g"]: r["q0_5"] for r in ranks.quantiles(df, ["g"], "v", [0.5]).collect()}
    original = ranks._brackets
    monkeypatch.setattr(ranks, "_brackets", lambda *a: original(*a).withColumn("_low", F.when(F.col("g") == 1, F.array(F.lit(-2.0))).otherwise(F.col("_low"))).withColumn(
        "_high", F.when(F.col("g") == 1, F.array(F.lit(-1.0))).otherwise(F.col("_high"))))
    assert {r["g"]: r["q0_5"] for r in ranks.quantiles(df, ["g"], "v", [0.5]).collect()} == want


def test_wide_correlations_equal_the_expression_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 30))
    base[:, 1] += base[:, 0]
    base[:, 2] = 1e9 + base[:, 0]
    base[:, 3] = 7.0
    rows = [[None if rng.random() < 0.2 else (math.nan if rng.random() < 0.05 else float(x)) for x in r] for r in base]
    for r in rows:
        r[4] = None
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlations(df, names).collect()}
    assert len(got) == 435
    monkeypatch.setattr(profile, "PAIRS", 1000)
    for r in profile.correlations(df, names).collect():
        value = got[r["a"], r["b"]]
        constant = {"c3", "c4"} & {r["a"], r["b"]}
        assert (value is None and r["corr"] is None) if constant else value == pytest.approx(r["corr"], abs=1e-3 if "c2" in (r["a"], r["b"]) else 1e-6)


def test_three_hundred_columns_take_one_scan(spark):
    df = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(300)])
    found = gram.correlations(df, df.columns)
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert text.count("Range (") == 1 and text.count("MapInArrow") == 1
    assert found.count() == 300 * 299 // 2
    assert found.where("a = 'c0' AND b = 'c5'").head()["corr"] == pytest.approx(df.agg(F.corr("c0", "c5")).head()[0])
