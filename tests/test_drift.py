import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import drift, monitor
from cohortlens.sources import files, logs


def values(frame, *xs):
    return frame("x double", *[(float(x),) for x in xs])


def normal(spark, n, shift=0.0, seed=1):
    rng = np.random.RandomState(seed)
    return spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(rng.normal(shift, 1, n))], "x double, b int")


def test_prediction_drift(frame):
    same = drift.prediction_drift(values(frame, .3, .4, .5, .6, .7), values(frame, .35, .45, .55, .65, .7), "x").head()
    moved = drift.prediction_drift(values(frame, .2, .3, .3, .4, .3), values(frame, .7, .8, .9, .85, .75), "x").head()
    assert same["drift_detected"] is False and moved["drift_detected"] is True
    assert same["reference_mean"] == 0.5 and same["reference_std"] == pytest.approx(0.1414)


def test_threshold_is_strict(frame):
    r = drift.prediction_drift(values(frame, 0.0), values(frame, 0.25), "x", 0.25).head()
    assert r["drift_detected"] is False


@pytest.mark.parametrize("n", [400, 3000])
def test_report_on_equal_and_shifted_data(spark, n):
    equal = drift.report(normal(spark, n), normal(spark, n, seed=2), test="ks")
    shifted = drift.report(normal(spark, n), normal(spark, n, shift=1.0, seed=2))
    assert {r["test"] for r in shifted.collect()} == {"wasserstein"}
    assert drift.summary(equal).head()["drift_detected"] is False
    s = drift.summary(shifted).head()
    assert s["drift_detected"] is True and s["drifted_features"] == ["x"]
    assert (s["n_features_analyzed"], s["n_features_drifted"]) == (2, 1)


def test_ks_and_wasserstein_against_numpy(spark):
    a, b = normal(spark, 300), normal(spark, 500, 0.3, 5)
    x, y = np.sort([r["x"] for r in a.collect()]), np.sort([r["x"] for r in b.collect()])
    grid = np.sort(np.concatenate([x, y]))
    fx, fy = np.searchsorted(x, grid, "right") / len(x), np.searchsorted(y, grid, "right") / len(y)
    got = drift.ks(a, b, ["x"]).head()
    assert got["ks"] == pytest.approx(np.abs(fx - fy).max())
    area = np.sum(np.abs(fx - fy)[:-1] * np.diff(grid)) / x.std()
    assert drift.wasserstein(a, b, ["x"]).head()["wasserstein"] == pytest.approx(area)


def test_ks_p_value_is_a_probability(spark):
    same = drift.ks(normal(spark, 200), normal(spark, 200), ["x"]).head()
    far = drift.ks(normal(spark, 200), normal(spark, 200, 3.0, 9), ["x"]).head()
    assert same["ks"] == 0.0 and same["ks_p_value"] == 1.0 and far["ks_p_value"] < 1e-6


def test_psi_and_js(spark):
    a = normal(spark, 2000)
    assert drift.psi(a, a, ["x"]).head()["psi"] == 0.0 and drift.js(a, a, ["x"]).head()["js_distance"] == 0.0
    b = normal(spark, 2000, 1.0, 3)
    assert drift.psi(a, b, ["x"]).head()["psi"] > 0.2 and 0.1 < drift.js(a, b, ["x"]).head()["js_distance"] < 1.0


def test_chi2(frame):
    a = frame("c string", *[("x",)] * 50, *[("y",)] * 50)
    b = frame("c string", *[("x",)] * 80, *[("y",)] * 20)
    r = drift.chi2(a, b, ["c"]).head()
    assert r["chi2"] == pytest.approx(2 * (15**2 / 65 + 15**2 / 35)) and r["dof"] == 1 and r["drift_detected"] is True
    assert drift.chi2(a, a, ["c"]).head()["drift_detected"] is False


def test_no_common_column(frame):
    with pytest.raises(ValueError):
        drift.report(frame("a double", (1.0,)), frame("b double", (1.0,)))


def test_result_does_not_depend_on_partitioning(spark):
    a, b = normal(spark, 500), normal(spark, 500, 0.2, 4)
    one = drift.ks(a.repartition(1), b.repartition(1), ["x"]).head()
    many = drift.ks(a.repartition(50), b.repartition(23), ["x"]).head()
    assert one == many


def test_gate(frame):
    few = monitor.drift_gate(values(frame, 0.1), values(frame, *[0.9] * 9), "x").head()
    enough = monitor.drift_gate(values(frame, 0.1), values(frame, *[0.9] * 10), "x").head()
    assert few["drift_detected"] is None and few["total_predictions"] == 9
    assert enough["drift_detected"] is True


LOG = "id bigint, timestamp string, risk_level string, probability_at_risk double"


def as_log(frame, *rows):
    return frame(LOG, *rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_stats_and_summary(frame):
    log = as_log(frame, (1, "2024-01-01 00:00:00", "HIGH", 0.9), (2, "2024-01-02 00:00:00", "LOW", 0.2))
    r = monitor.stats(log).head()
    assert (r["total_predictions"], r["n_high"], r["n_low"]) == (2, 1, 1)
    assert r["avg_probability_at_risk"] == pytest.approx(0.55) and str(r["latest_prediction"]) == "2024-01-02 00:00:00"
    assert monitor.stats(log, 1).head()["n_low"] == 1
    assert {x["risk_level"]: x["n"] for x in monitor.risk_distribution(log).collect()} == {"HIGH": 1, "LOW": 1}
    metrics = frame("timestamp string, accuracy double", ("2024-01-01", 0.8), ("2024-01-03", 0.9))
    s = monitor.summary(log, metrics).head()
    assert s["latest_model_metrics"]["accuracy"] == 0.9 and s["avg_risk_probability"] == pytest.approx(0.55)


def test_empty_log(frame):
    r = monitor.stats(as_log(frame)).head()
    assert r["total_predictions"] == 0 and r["avg_probability_at_risk"] is None


def test_drift_row_fits_the_log_table(spark, tmp_path):
    found = drift.summary(drift.report(normal(spark, 100), normal(spark, 100, 2.0, 3)))
    row = logs.drift_row(found, "2024-01-01 10:00:00", "none")
    logs.append(row, str(tmp_path / "drift"))
    back = logs.read(spark, str(tmp_path / "drift"), logs.DRIFT_LOG).head()
    assert back["drifted_features"] == ["x"] and back["n_features_drifted"] == 1


def test_drift_between_files(spark, tmp_path):
    a, b = (files.write_csv(normal(spark, 200, s, 3 + i), str(tmp_path / str(i))) for i, s in enumerate((0.0, 2.0)))
    got = drift.report(files.read_csv(spark, a), files.read_csv(spark, b))
    assert drift.summary(got).head()["drifted_features"] == ["x"]


def test_sketched_edges_are_close_to_exact_ones(spark):
    a, b = normal(spark, 4000), normal(spark, 4000, 0.5, 3)
    exact, near = drift.psi(a, b, ["x"]).head()["psi"], drift.psi(a, b, ["x"], accuracy=10000).head()["psi"]
    assert near == pytest.approx(exact, rel=0.02)


def test_the_test_is_a_parameter(spark, frame):
    a, b = frame("x double, y int", (1.0, 0), (2.0, 1)), frame("x double, y int", (1.0, 0), (2.0, 1))
    got = {r["column"]: r["test"] for r in drift.report(a, b, test={"y": "js_distance"}).collect()}
    assert got == {"x": "wasserstein", "y": "js_distance"}
    with pytest.raises(ValueError):
        drift.report(a, b, test="other")


def test_missing_sides_leave_a_record(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x,y\n1,a\n2,b\n")
    other = tmp_path / "b.csv"
    other.write_text("z\nq\n")
    for paths, status in (((str(path), str(tmp_path / "none.csv")), "no current data"), ((str(tmp_path / "none"), str(path)), "no reference data"),
                          ((str(path), str(other)), "no common numeric column"), ((str(path), str(path)), "compared")):
        features, summary = drift.report_files(spark, *paths)
        row = summary.head()
        assert row["status"] == status and row["n_features_analyzed"] == features.count() and row["drift_detected"] is False
