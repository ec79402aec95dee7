import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cohortlens.operators import logistic, models, split
from cohortlens.session import materialize

COLUMNS = ("features", "label", "weight", "fold")


@pytest.fixture(scope="module")
def train(spark):
    """Large and small values, a sum of two other columns, a constant one."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 5)) * [1, 5, 0.1, 1, 1] + [0, 100, 0, 0, 0]
    x[:, 3], x[:, 4] = x[:, 0] + x[:, 2], 7.0
    y = x[:, 0] + rng.standard_normal(600) > 0.5
    rows = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "k bigint, a double, b double, c double, d double, e double, label int")
    return materialize(models.assemble(rows.repartition(3), list("abcde"), "label", ["k"]), "logistic")


def test_models_are_those_of_single_fits(train):
    weight = models.total_weight(train)
    strengths = [1 / (c * weight) for c in (0.01, 1.0, 10.0)]
    folded = split.folds(train, "label", "k", 3)
    points, hits = logistic.fold_models(folded, strengths, 3, 1000, *COLUMNS)
    for m, point in enumerate(points):
        fold, strength = divmod(m, 3)
        single = models.catalog()["LogisticRegression"].build(weight).setRegParam(strengths[strength]).setTol(1e-10).fit(folded.where(F.col("fold") != fold))
        assert point[:-1] == pytest.approx(single.coefficients.toArray(), abs=2e-3) and point[-1] == pytest.approx(single.intercept, abs=2e-1)
    assert sum(r["n"] for r in hits) == 3 * 600


def test_a_grid_needs_one_single_fit(train, monkeypatch):
    fits, passes, fit, slopes = [], [], LogisticRegression.fit, logistic._slopes
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, *given: fits.append(1) or fit(self, *given))
    monkeypatch.setattr(logistic, "_slopes", lambda *given: passes.append(1) or slopes(*given))
    model, _, params = models.train_best(train, "k", "LogisticRegression", k=3)
    assert type(model).__name__ == "LogisticRegressionModel" and len(fits) == 1 and len(passes) < 40
    assert any(params["regParam"] == pytest.approx(1 / (c * models.total_weight(train))) for c in models.GRIDS["LogisticRegression"]["C"])
    del fits[:]
    assert models.cross_validate(train, "k", ["LogisticRegression"], k=3).head()["mean_score"] > 0.6 and not fits


def test_scores_are_those_of_the_cross_validator(train, monkeypatch):
    together = [r["score"] for r in models.fold_scores(train, "k", ["LogisticRegression"], k=3).orderBy("fold").collect()]
    monkeypatch.setattr(logistic, "WIDEST", 4)  # wider rows are fitted one by one
    single = [r["score"] for r in models.fold_scores(train, "k", ["LogisticRegression"], k=3).orderBy("fold").collect()]
    assert together == pytest.approx(single, abs=0.02)


def test_folds_of_one_class_and_without_rows(frame):
    rows = frame("k bigint, x double, label int", *[(i, float(i), 1 if i == 0 else 0) for i in range(6)])
    folded = models.assemble(rows, ["x"], "label", ["k"]).withColumn("fold", F.when(F.col("k") == 0, 0).otherwise(1))
    points, _ = logistic.fold_models(folded, [0.1], 2, 100, *COLUMNS)
    assert points[0].tolist() == [0.0, -np.inf] and points[1].tolist() == [0.0, np.inf]
    with pytest.raises(ValueError, match="training data"):
        logistic.fold_models(folded.where("fold = 1"), [0.1], 2, 100, *COLUMNS)
