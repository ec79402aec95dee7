import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import evaluate, kernel, models, profile, target
from cohortlens.plans import prepare, training
from cohortlens.plans.scoring import Scorer, score_file, score_valid
from cohortlens.session import materialize
from cohortlens.sources import files, logs
from helpers import LIGHT, NOW



@pytest.fixture(scope="module")
def prepared(panel, spec):
    matrix, prep = prepare.prepare(panel, spec)
    matrix = matrix.cache()
    yield matrix, prep
    matrix.unpersist()


def test_catalog():
    found = models.catalog()
    assert {n: len(c.points()) for n, c in found.items()} == {
        "LogisticRegression": 4, "RandomForest": 36, "GradientBoosting": 36, "SVM": 6, "XGBoost": 108}
    assert found["LogisticRegression"].weighted and not found["XGBoost"].weighted


def test_prepared_matrix(prepared, spec):
    matrix, prep = prepared
    assert matrix.columns == ["row_id", "label", "split", *prep.columns]
    nulls = matrix.select([F.count_if(F.col(c).isNull()).alias(c) for c in matrix.columns]).head()
    assert sum(nulls) == 0
    train = matrix.where("split = 'train'")
    r = train.agg(F.avg("INDE_2022"), F.stddev_pop("INDE_2022")).head()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9
    assert not any("DEFASAGEM" in c for c in prep.columns) and "INDE_trend" in prep.columns


def test_preparation_round_trip(spark, prepared, panel, tmp_path):
    _, prep = prepared
    prep.save(str(tmp_path / "p"))
    again = prepare.Preparation.load(spark, str(tmp_path / "p"))
    a, b = prep.transform(panel, ["row_id"]), again.transform(panel, ["row_id"])
    assert a.columns == b.columns and a.exceptAll(b).count() == 0


def test_row_result_does_not_depend_on_neighbours(prepared, panel):
    _, prep = prepared
    one = panel.where("row_id = 7").withColumn("TURMA_2022", F.lit("unseen"))
    alone = prep.transform(one, ["row_id"]).head()
    together = prep.transform(panel.where("row_id <> 7").unionByName(one), ["row_id"]).where("row_id = 7").head()
    assert alone == together


def test_missing_columns_are_filled(prepared, panel):
    _, prep = prepared
    assert prep.transform(panel.select("row_id", "INDE_2022"), ["row_id"]).columns == ["row_id", *prep.columns]


def test_unknown_names(spark, prepared):
    matrix, prep = prepared
    train = models.assemble(matrix, prep.columns, "label", ["row_id"])
    with pytest.raises(ValueError):
        models.train_best(train, "row_id", "Nope")
    with pytest.raises(ValueError):
        models.scorer("rmse")
    with pytest.raises(ValueError):
        models.select_features(matrix, prep.columns, "label", "nope", 3)


def test_cross_validation(prepared):
    matrix, prep = prepared
    train = models.assemble(matrix.where("split = 'train'"), prep.columns, "label", ["row_id"])
    rows = models.cross_validate(train, "row_id", ["LogisticRegression", "RandomForest"], k=2, settings=LIGHT).collect()
    assert [r["mean_score"] for r in rows] == sorted((r["mean_score"] for r in rows), reverse=True)
    assert all(0 <= r["min_score"] <= r["mean_score"] <= r["max_score"] <= 1 and r["time_seconds"] >= 0 for r in rows)


def test_training_beats_the_constant_guess(trained):
    _, outcome = trained
    positive = outcome.predictions.agg(F.avg("y_true")).head()[0]
    constant_f1 = 2 * positive / (1 + positive)
    r = outcome.evaluation.head()
    assert r["f1_score"] > constant_f1 and r["auc_roc"] > 0.6
    assert r["n_test_samples"] == outcome.predictions.count()
    assert set(outcome.params) == {"regParam"}


def test_scaled_rows_are_not_written(spark, panel, spec, monkeypatch):
    written = []
    monkeypatch.setattr(training, "materialize", lambda df, purpose: written.append(purpose) or materialize(df, purpose))
    job = training.TrainJob(spark, spec, model="LogisticRegression", folds=2, grids={"LogisticRegression": {"C": (1.0,)}}, settings=LIGHT)
    outcome = job.run(panel)
    assert written == ["predictions", "evaluation"]
    assert outcome.evaluation.head()["n_test_samples"] == outcome.predictions.count() > 0


def test_artifacts(spark, trained):
    out, outcome = trained
    report = logs.read_report(spark, f"{out}/evaluation_report").head()
    assert report["n_test_samples"] == outcome.evaluation.head()["n_test_samples"]
    assert "macro avg" in report["classification_report"]
    top = [x["importance"] for x in report["feature_importance"]]
    assert top == sorted(top, reverse=True) and len(top) == len(outcome.scorer.preparation.columns)
    metrics = logs.read(spark, f"{out}/model_metrics", logs.METRICS_LOG).head()
    assert metrics["model_type"] == "LogisticRegressionModel" and 0 <= metrics["precision_score"] <= 1


def test_saved_model_gives_the_same_predictions(spark, trained, panel):
    out, outcome = trained
    again = Scorer.load(spark, f"{out}/scorer")
    a = outcome.scorer.predict(panel, ["row_id"], NOW)
    b = again.predict(panel, ["row_id"], NOW)
    assert a.exceptAll(b).count() == 0
    with pytest.raises(FileNotFoundError):
        Scorer.load(spark, f"{out}/nowhere")


def test_prediction_records(trained, panel):
    _, outcome = trained
    rows = outcome.scorer.predict(panel.limit(40), ["row_id"], NOW).collect()
    assert len(rows) == 40
    for r in rows:
        assert r["prediction"] in (0, 1) and r["risk_level"] == ("HIGH" if r["prediction"] else "LOW")
        assert r["probability"]["no_risk"] + r["probability"]["at_risk"] == pytest.approx(1.0, abs=2e-4)


def test_empty_batch(trained, panel):
    _, outcome = trained
    assert outcome.scorer.predict(panel.limit(0), ["row_id"], NOW).count() == 0


def test_partial_records(trained, frame):
    _, outcome = trained
    df = frame("row_id bigint, INDE_2022 double, TURMA_2022 string", (1, 6.0, "B"), (2, None, None))
    assert outcome.scorer.predict(df, ["row_id"], NOW).count() == 2


def test_out_of_bounds_records_are_not_scored(trained, panel):
    _, outcome = trained
    bad = panel.limit(10).withColumn("INDE_2022", F.when(F.col("row_id") % 2 == 0, 11.0).otherwise(5.0))
    scored, quarantine = score_valid(outcome.scorer, bad, ["row_id"], NOW)
    assert scored.count() == 5 and quarantine.count() == 5
    assert quarantine.head()["violations"] == ["INDE_2022"]


def test_file_to_file(spark, trained, panel, tmp_path):
    _, outcome = trained
    source = files.write_csv(panel, str(tmp_path / "in"))
    summary = score_file(spark, outcome.scorer, source, str(tmp_path / "out"), str(tmp_path / "log"), NOW).head()
    assert summary["total"] == 400 == summary["n_high"] + summary["n_low"]
    assert logs.read(spark, str(tmp_path / "log")).count() == 400
    assert files.read_csv(spark, str(tmp_path / "out")).columns[-3:] == ["prediction", "risk_level", "probability_at_risk"]


def test_importance(spark, prepared, trained):
    matrix, prep = prepared
    train = models.assemble(matrix, prep.columns, "label", ["row_id"])
    forest = models.catalog()["RandomForest"].build(1.0, trees=5, depth=4).fit(train)
    ranked = models.importance(forest, prep.columns, spark)
    values = [r["importance"] for r in ranked.collect()]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1.0)
    assert evaluate.top_importance(ranked, 10).count() == 10
    assert models.importance(object(), prep.columns, spark).count() == 0
    svm = models.catalog()["SVM"].build(models.total_weight(train), max_iter=5).fit(train)
    assert models.importance(svm, prep.columns, spark).count() == len(prep.columns)


def test_svm_probabilities(prepared):
    matrix, prep = prepared
    train = models.assemble(matrix, prep.columns, "label", ["row_id"])
    svm = models.catalog()["SVM"].build(models.total_weight(train), max_iter=10)
    out = models.calibrated_svm(train, "row_id", svm, 2).transform(train)
    rows = out.select("prediction", "probability").collect()
    assert all(0 <= r["probability"][1] <= 1 for r in rows) and {r["prediction"] for r in rows} <= {0.0, 1.0}
    higher = [r["probability"][1] for r in rows if r["prediction"] == 1.0]
    lower = [r["probability"][1] for r in rows if r["prediction"] == 0.0]
    assert min(higher) >= max(lower)


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no line divides."""
    u, v = F.rand(1) * 6.283185307, F.rand(2)
    r = F.when(F.col("id") % 2 == 0, 0.4 * v).otherwise(1.0 + 0.4 * v)
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), r.alias("r"), u.alias("u"))
    rows = materialize(rows.select("id", "y", (F.col("r") * F.cos("u")).alias("a"), (F.col("r") * F.sin("u")).alias("b")), "rings")
    return materialize(models.assemble(rows, ["a", "b"], "y", ["id"]), "rings-train")


def test_fourier_features_are_near_the_kernel(rings, tmp_path):
    fitted = kernel.FourierFeatures(frequencies=512, seed=3).fit(rings)
    x = np.array([r[0].toArray() for r in rings.select("features").collect()])
    assert fitted.getOrDefault("gamma") == pytest.approx(1 / (2 * x.var()))
    fitted.write().save(str(tmp_path / "map"))
    again = kernel.FourierFeaturesModel.load(str(tmp_path / "map"))
    z = np.array([r[0].toArray() for r in again.transform(rings).select("mapped").collect()])
    exact = np.exp(-fitted.getOrDefault("gamma") * ((x[:, None] - x[None]) ** 2).sum(2))
    assert abs(z @ z.T - exact).max() < kernel.error_bound(512) and np.sqrt(((z @ z.T - exact) ** 2).mean()) < 0.04
    assert kernel.FourierFeatures(gamma=0.5).fit(rings).getOrDefault("gamma") == 0.5


def test_select_features(panel):
    df = target.binarize(panel.na.fill(0.0), "DEFASAGEM_2022", "already_binary")
    cols = [f"{s}_2022" for s in ("INDE", "IAA", "IEG", "IPS")]
    assert models.select_features(df, cols, "label") == cols
    assert set(models.select_features(df, cols, "label", "correlation", 2)) == {"INDE_2022", "IAA_2022"}
    assert len(models.select_features(df, cols, "label", "importance", 3, trees=5)) == 3
    r = profile.correlation_with(df, cols, "label").where("column = 'INDE_2022'").head()
    assert 0 < r["abs_corr"] < 1


def test_the_machines_of_a_calibration_are_fitted_side_by_side(spark, frame, monkeypatch):
    import threading

    from pyspark.ml.classification import LinearSVC

    rows = frame("k bigint, x double, label int", *[(i, float(i % 7) + (2.0 if i % 2 else 0.0), i % 2) for i in range(40)])
    train = models.assemble(rows, ["x"], "label", ["k"])
    svm = models.catalog()["SVM"].build(models.total_weight(train), max_iter=3)
    both, fit = threading.Barrier(2), LinearSVC.fit

    def watched(self, *given):
        both.wait(60)
        return fit(self, *given)

    monkeypatch.setattr(LinearSVC, "fit", watched)
    probability = models.calibrated_svm(train, "k", svm, 3).transform(train).select("k", "probability").collect()
    assert len(probability) == 40 and all(abs(sum(r["probability"]) - 1) < 1e-9 for r in probability)
