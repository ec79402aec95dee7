import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.numeric import log_gamma, upper_gamma
from cohortlens.operators import drift, reference


def side(spark, n, shift=0.0, start="2024-01-01", days=5):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id") % days * 86400)
    u = F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0
    return spark.range(n).select(
        at.alias("at"), (u + shift).alias("x"), F.pow(u, F.lit(4.0)).alias("skewed"), (F.col("id") % 7).cast("int").alias("few"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, u).alias("gaps"), F.lit(None).cast("double").alias("none"))


COLUMNS = ["x", "skewed", "few", "gaps", "none"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("profile"))
    reference.store(side(spark, 20_000), COLUMNS, "at", path)
    return path


@pytest.mark.parametrize("shift", [0.0, 0.1, 2.0])
def test_distances_lie_within_their_error(spark, stored, shift):
    old, new = side(spark, 20_000), side(spark, 7_000, shift)
    found = {r["column"]: r for r in reference.check(reference.load(spark, stored), new, COLUMNS).collect()}
    assert set(found) == set(COLUMNS) - {"none"}
    for r in drift.report(old, new, ["x", "skewed", "few", "gaps"]).collect():
        own = found[r["column"]]
        assert (own["n_ref"], own["n_cur"]) == (r["n_ref"], r["n_cur"])
        assert abs(own["ks"] - r["ks"]) <= reference.ks_error()
        assert abs(own["wasserstein"] - r["wasserstein"]) <= 0.05
    assert found["x"]["drift_detected"] is (shift > 0)


def test_moments_and_distinct_values_merge(spark, stored):
    whole = {r["column"]: r for r in side(spark, 20_000).select(
        F.lit("x").alias("column"), F.col("x").alias("v")).groupBy("column").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count_distinct("v").alias("d")).collect()}
    got = {r["column"]: r for r in reference.load(spark, stored).withColumn("d", F.hll_sketch_estimate("hll")).collect()}
    assert (got["x"]["mean"], got["x"]["m2"] / got["x"]["n"]) == pytest.approx((whole["x"]["mean"], whole["x"]["var"]))
    assert got["x"]["d"] == pytest.approx(whole["x"]["d"], rel=0.05) and got["few"]["d"] == 7
    assert (got["gaps"]["n"], got["gaps"]["n_null"]) == (6667, 13_333) and got["none"]["kll"] is None


def test_the_reference_is_not_read_again_and_days_are_pruned(spark, stored):
    found = reference.check(reference.load(spark, stored, since="2024-01-02", until="2024-01-04"), side(spark, 100), COLUMNS)
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    scans = [line for line in text.splitlines() if "Location:" in line]
    assert scans and all(stored in line for line in scans) and "PartitionFilters" in text
    assert found.where("column = 'x'").head()["n_ref"] == 8_000


def test_a_day_is_replaced(spark, stored, tmp_path):
    path = str(tmp_path / "p")
    reference.store(side(spark, 1_000), ["x"], "at", path)
    reference.store(side(spark, 50, 0.0, "2024-01-03", 1), ["x"], "at", path)
    assert reference.load(spark, path).head()["n"] == 850
    with pytest.raises(ValueError):
        reference.check(reference.load(spark, path), side(spark, 10), ["x"], test="psi")


def tail(dof, x):
    """Upper tail of the chi-square distribution by its finite sums."""
    if dof % 2 == 0:
        return math.fsum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(dof // 2))
    return math.erfc(math.sqrt(x / 2)) + math.fsum(math.exp(-x / 2 + (k - 0.5) * math.log(x / 2) - math.lgamma(k + 0.5)) for k in range(1, (dof + 1) // 2))


def test_chi_square_tail(spark):
    rows = [(d, float(x)) for d in [*range(1, 41), 55, 99, 100, 150, 199, 200] for x in (0.01 * d, 0.3 * d, 0.9 * d, d, 1.1 * d, 1.6 * d, 3.0 * d, d + 40)]
    df = spark.createDataFrame(rows, "dof int, x double")
    for r in df.withColumn("p", upper_gamma(F.col("dof") / 2, F.col("x") / 2)).collect():
        assert r["p"] == pytest.approx(tail(r["dof"], r["x"]), abs=1e-10)
    big = spark.createDataFrame([(20_000, 20_000.0), (20_000, 20_500.0)], "dof int, x double").withColumn("p", upper_gamma(F.col("dof") / 2, F.col("x") / 2)).collect()
    assert [r["p"] for r in big] == pytest.approx([tail(20_000, 20_000.0), tail(20_000, 20_500.0)], abs=1e-8)


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 3.7, 9.99, 10.0, 50.5, 1e5]
    got = [r["g"] for r in spark.createDataFrame([(v,) for v in values], "a double").withColumn("g", log_gamma(F.col("a"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], abs=1e-10, rel=1e-12)


def test_chi_square_of_equal_and_single_categories(frame):
    one = frame("c string, d string", ("a", "x"), ("b", "x"))
    found = {r["column"]: r for r in drift.chi2(one, one, ["c", "d"]).collect()}
    assert (found["c"]["p_value"], found["d"]["p_value"]) == (1.0, 1.0) and not found["c"]["drift_detected"]
