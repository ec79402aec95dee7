import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from cohortlens.operators import split
from cohortlens.plans import prepare, stages


@pytest.fixture(scope="module")
def rows(panel, spec):
    return split.stratified(prepare.labelled(panel, spec), prepare.LABEL, spec.key).cache()


@pytest.mark.parametrize("engineered", [False, True])
def test_a_saved_pipeline_equals_the_preparation(rows, panel, spec, tmp_path, engineered):
    keep = [spec.key, prepare.LABEL, prepare.SPLIT]
    steps, columns = stages.stages(rows, spec, keep, engineered=engineered)
    model = Pipeline(stages=steps).fit(rows.where("split = 'train'"))
    model.write().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(rows).select(*keep, *columns)
    want, prep = prepare.prepare(panel, spec, engineered=engineered)
    assert columns == prep.columns
    near = lambda df: df.select(*keep, *[(F.round(F.col(c), 9) + 0.0).alias(c) for c in columns])
    assert near(got).exceptAll(near(want)).count() == 0 and got.count() == want.count()


def test_an_unfitted_pipeline_is_saved_too(rows, spec, tmp_path):
    steps, _ = stages.stages(rows, spec, [spec.key, prepare.LABEL, prepare.SPLIT])
    Pipeline(stages=steps).write().save(str(tmp_path / "p"))
    back = Pipeline.load(str(tmp_path / "p")).getStages()
    assert [type(s) for s in back] == [type(s) for s in steps]
    assert back[2].features() == steps[2].features() and back[0].getInputCols() == steps[0].getInputCols()


def test_fills_are_fitted_inside_folds(spark, tmp_path):
    """A value that only the rows of one fold have moves the mean of the others by a known amount."""
    df = spark.range(90).select(
        "id", (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 3 == 0, 30.0).when(F.col("id") % 10 != 1, 0.0).alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    imputer = stages.PanelImputer(inputCols=["x"], strategy="mean")
    seen = []
    original = stages.PanelImputer._fit

    def watched(self, dataset):
        model = original(self, dataset)
        seen.append((self.getStrategy(), sorted(r["fold"] for r in dataset.select("fold").distinct().collect()), model.fill_values()["x"]))
        return model

    pipeline = Pipeline(stages=[imputer, stages.PanelScaler(inputCols=["x"]), VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=2)])
    grid = ParamGridBuilder().addGrid(imputer.strategy, ["mean", "median"]).build()
    validator = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="fold")
    stages.PanelImputer._fit = watched
    try:
        model = validator.fit(df)
    finally:
        stages.PanelImputer._fit = original
    means = {tuple(f): v for s, f, v in seen if s == "mean"}
    assert means[1, 2] == 0.0 and means[0, 1] == pytest.approx(means[0, 2]) and 0 < means[0, 1] < 30
    assert {s for s, _, _ in seen} == {"mean", "median"} and len(model.avgMetrics) == 2
    model.write().save(str(tmp_path / "cv"))
    again = CrossValidatorModel.load(str(tmp_path / "cv"))
    assert again.transform(df).select("id", "prediction").exceptAll(model.transform(df).select("id", "prediction")).count() == 0


def test_unseen_null_and_all_null_values(frame):
    train = frame("x double, y double, t string, o string", (1.0, None, "b", "Quartzo"), (3.0, None, "a", None), (float("nan"), None, None, "Topázio"))
    steps = [stages.PanelImputer(inputCols=["x", "y"]), stages.PanelEncoder(inputCols=["t"], ordinalCols=["o"]), stages.PanelScaler(inputCols=["x", "y", "t"])]
    model = Pipeline(stages=steps).fit(train)
    fills = model.stages[0].fill_values()
    assert fills == {"x": 2.0} and json.loads(model.stages[2].getOrDefault("moments"))["y"] == [None, None]
    new = frame("x double, y double, t string, o string", (None, 5.0, "new", "other"), (2.0, None, None, "Quartzo"))
    first, second = model.transform(new).collect()
    assert first["x"] == second["x"] == 0.0 and first["y"] == 0.0 and first["t"] == second["t"] and first["o"] == 0.0 and second["o"] == 1.0
    with pytest.raises(ValueError):
        model.stages[0].transform(new.drop("x"))
