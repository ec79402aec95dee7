import math

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from cohortlens.operators import kernel, logistic, machines, models, split
from cohortlens.session import materialize

COLUMNS = ("features", "label", "weight", "fold")
GRID = {"SVM": {"C": (0.1, 1.0), "kernel": ("linear", "rbf")}}
FEW = {"SVM": {"frequencies": 20, "max_iter": 25}}


@pytest.fixture(scope="module")
def train(spark):
    """Two classes divided by a ring, more or less, and a column that is a sum of two others."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 4)) * [1, 1, 3, 1]
    x[:, 3] = x[:, 0] + x[:, 2]
    y = x[:, 0] ** 2 + x[:, 1] ** 2 + 0.3 * rng.standard_normal(600) > 1.5
    rows = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "k bigint, a double, b double, c double, d double, label int")
    return materialize(models.assemble(rows.coalesce(2), list("abcd"), "label", ["k"]), "machines")


@pytest.fixture(scope="module")
def folded(train):
    return materialize(split.folds(train, "label", "k", 3), "folded")


def cost(rows, column, point, strength):
    """Weighted mean hinge loss and penalty."""
    x, y, w = (np.array(v) for v in zip(*[(r[column].toArray(), r["label"], r["weight"]) for r in rows.collect()]))
    hinge = np.maximum(1 - (2 * y - 1) * (x @ point[:-1] + point[-1]), 0)
    return (w * hinge).sum() / w.sum() + strength / 2 * (point[:-1] ** 2).sum()


@pytest.mark.parametrize("kind", ["linear", "rbf"])
def test_machines_cost_no_more_than_single_fits(train, folded, kind):
    weight = models.total_weight(train)
    strengths = [1 / (c * weight) for c in (0.1, 1.0)]
    single = models.catalog()["SVM"].build(weight, kernel=kind, frequencies=20, max_iter=25)
    mapping = None if kind == "linear" else models._map(folded, single.getStages()[0], 3, 2)
    points, hits = machines.fold_models(folded, strengths, 3, 100, *COLUMNS, mapping)
    for m in (1, 4):
        point, (fold, strength) = points[m], divmod(m, 2)
        rows, core = folded.where(F.col("fold") != fold), models._core(single)
        fitted = single.fit(rows, {core.regParam: strengths[strength]})
        machine = fitted if kind == "linear" else fitted.stages[-1]
        column = "features" if kind == "linear" else "mapped"
        seen = rows if kind == "linear" else fitted.transform(rows)
        own = np.append(machine.coefficients.toArray(), machine.intercept)
        assert cost(seen, column, point, strengths[strength]) < cost(seen, column, own, strengths[strength]) + machines.ROUND / 4
    assert sum(r["n"] for r in hits) == 2 * 600


def test_a_grid_needs_one_single_fit(train, monkeypatch):
    fits, passes, fit, slopes = [], [], LinearSVC.fit, machines._slopes
    monkeypatch.setattr(LinearSVC, "fit", lambda self, *given: fits.append(1) or fit(self, *given))
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, data, own=LinearSVC._fit: fits.append(2) or own(self, data))
    monkeypatch.setattr(machines, "_slopes", lambda *given: passes.append(1) or slopes(*given))
    model, _, params = models.train_best(train, "k", "SVM", k=3, grids=GRID, settings=FEW)
    # the ring is for the kernel; its machine is fitted once, however its pipeline does it
    assert params["kernel"] == "rbf" and len(fits) in (1, 2) and len(passes) < 150
    del fits[:]
    estimator = models.catalog()["SVM"].build(1.0, kernel="rbf", frequencies=20).copy({})
    machine = model.stages[-1]
    estimator.getStages()[0]._set(gamma=model.stages[0].getOrDefault("gamma"))
    estimator.getStages()[-1].setRegParam(machine.getRegParam())
    out = models.calibrated_svm(train, "k", estimator, 3, model).transform(train).select("label", "probability").collect()
    assert not fits and len(out) == 600 and sum((r["probability"][1] > 0.5) == (r["label"] == 1) for r in out) > 500


def test_scores_are_those_of_single_fits(train, monkeypatch):
    together = [r["score"] for r in models.fold_scores(train, "k", ["SVM"], k=3, settings={"SVM": {"kernel": "rbf", **FEW["SVM"]}}).orderBy("fold").collect()]
    monkeypatch.setattr(logistic, "WIDEST", 3)  # wider rows are fitted one by one
    single = [r["score"] for r in models.fold_scores(train, "k", ["SVM"], k=3, settings={"SVM": {"kernel": "rbf", **FEW["SVM"]}}).orderBy("fold").collect()]
    assert together == pytest.approx(single, abs=0.03) and min(together) > 0.6


def test_margins_are_out_of_fold(folded):
    points = np.arange(15.0).reshape(3, 5)
    got = sorted(tuple(r[1]) for r in machines.margins(folded, points, *COLUMNS).collect())
    assert got == [pytest.approx(v) for v in sorted((-m, m) for r in folded.collect() for m in [float(points[r["fold"], :4] @ r["features"].toArray() + points[r["fold"], 4])])]


def test_maps_are_those_of_the_kernel(folded):
    fitted = kernel.FourierFeatures(frequencies=20, seed=models.SEED, gamma=0.2).fit(folded)
    mapping = machines.Map(models.SEED, 4, 20, (math.sqrt(0.4),) * 3)
    points = np.random.default_rng(1).standard_normal((3, 41))
    got = sorted(r[1][1] for r in machines.margins(folded, points, *COLUMNS, mapping).collect())
    want = [float(points[r["fold"], :40] @ r["mapped"].toArray() + points[r["fold"], 40]) for r in fitted.transform(folded).collect()]
    assert got == pytest.approx(sorted(want), abs=1e-4)


def test_folds_that_cannot_be_fitted_together(folded):
    assert machines.fold_models(folded.withColumn("label", F.col("label") + 1), [0.1], 3, 10, *COLUMNS) is None
    with pytest.raises(ValueError, match="training data"):
        machines.fold_models(folded.withColumn("fold", F.lit(1)), [0.1], 2, 10, *COLUMNS)
    one = folded.withColumn("label", F.when(F.col("fold") == 0, F.col("label")).otherwise(0.0))
    points, _ = machines.fold_models(one, [0.1], 3, 100, *COLUMNS)
    assert np.isfinite(points).all() and points[0][-1] < -0.9
