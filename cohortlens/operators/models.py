"""Model catalog, cross-validation, tuning, importance and feature selection on pyspark.ml."""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from cohortlens import constants as C
from cohortlens.functions.numeric import named
from cohortlens.operators import evaluate, kernel as kernels, logistic, machines, profile, split, target
from cohortlens.session import materialize

FEATURES, LABEL, WEIGHT, FOLD = "features", "label", "weight", "fold"
SEED = C.SEED

# The metric behind each scoring name, always for class 1.
SCORERS = {"f1": "fMeasureByLabel", "recall": "recallByLabel", "precision": "precisionByLabel", "accuracy": "accuracy"}

# Hyper-parameter grids of the five candidates.
GRIDS = {
    "LogisticRegression": {"C": (0.01, 0.1, 1.0, 10.0)},
    "RandomForest": {"trees": (100, 200, 300), "depth": (5, 10, 15, None), "min_split": (2, 5, 10)},
    "GradientBoosting": {"trees": (100, 200), "depth": (3, 5, 7), "rate": (0.01, 0.1, 0.2), "subsample": (0.8, 1.0)},
    "SVM": {"C": (0.1, 1.0, 10.0), "kernel": ("linear", "rbf")},
    "XGBoost": {
        "trees": (100, 200, 300), "depth": (3, 5, 7), "rate": (0.01, 0.1, 0.2), "subsample": (0.8, 1.0),
        "colsample": (0.8, 1.0),
    },
}
MAX_DEPTH = 30  # the deepest tree that Spark grows stands in for unlimited depth


@dataclass(frozen=True)
class Candidate:
    """An estimator factory and its grid. `weighted` models train with balanced class weights."""

    name: str
    grid: dict
    weighted: bool

    def points(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in product(*self.grid.values())]

    def build(self, total_weight: float = 1.0, **chosen) -> Estimator:
        return _BUILDERS[self.name](total_weight, **chosen)


def _logistic(total_weight, C=1.0, max_iter=1000):
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, elasticNetParam=0.0,
                              standardization=False, regParam=1.0 / (C * total_weight), maxIter=max_iter)


def _forest(total_weight, trees=100, depth=None, min_split=2):
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=trees,
                                  maxDepth=depth or MAX_DEPTH, minInstancesPerNode=max(1, min_split // 2),
                                  featureSubsetStrategy="sqrt", seed=SEED)


def _boosting(total_weight, trees=100, depth=3, rate=0.1, subsample=1.0, colsample=1.0):
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=rate,
                         subsamplingRate=subsample, featureSubsetStrategy="all" if colsample == 1.0 else str(colsample),
                         seed=SEED)


def _xgboost(total_weight, trees=100, depth=6, rate=0.3, subsample=1.0, colsample=1.0):
    return _boosting(total_weight, trees, depth, rate, subsample, colsample)


def _svm(total_weight, C=1.0, max_iter=100, kernel="linear", frequencies=kernels.FREQUENCIES):
    """A linear machine, or with the kernel `rbf` one behind a map whose inner products are close to the Gaussian kernel."""
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"unknown kernel {kernel!r}; one of ['linear', 'rbf']")
    machine = LinearSVC(featuresCol=FEATURES if kernel == "linear" else "mapped", labelCol=LABEL, weightCol=WEIGHT, standardization=False,
                        regParam=1.0 / (C * total_weight), maxIter=max_iter)
    if kernel == "linear":
        return machine
    return Pipeline(stages=[kernels.FourierFeatures(inputCol=FEATURES, outputCol="mapped", frequencies=frequencies, seed=SEED), machine])


_BUILDERS = {
    "LogisticRegression": _logistic, "RandomForest": _forest, "GradientBoosting": _boosting, "SVM": _svm, "XGBoost": _xgboost,
}


def catalog() -> dict[str, Candidate]:
    weighted = {"LogisticRegression", "RandomForest", "SVM"}
    return {name: Candidate(name, grid, name in weighted) for name, grid in GRIDS.items()}


def assemble(df: DataFrame, columns: list[str], label: str, keep: list[str] = ()) -> DataFrame:
    """`features` vector, `label` as double, and balanced class weights as `weight`.

    The weights are one row per class; Spark sees their size and chooses the join.
    """
    weights = materialize(target.class_weights(df, label), "weights").select(F.col("label").alias("_class"), F.col("weight").alias(WEIGHT))
    base = df.where(named(label).isNotNull())
    joined = base.join(weights, named(label) == F.col("_class")).withColumn(LABEL, named(label).cast("double"))
    vector = VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error")
    return vector.transform(joined).select(*[named(k) for k in keep], FEATURES, LABEL, WEIGHT)


def from_vectors(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """Training frame from an array column."""
    weights = materialize(target.class_weights(df, label), "weights").select(F.col("label").alias("_class"), F.col("weight").alias(WEIGHT))
    joined = df.join(weights, named(label) == F.col("_class"))
    return joined.select(named(key), array_to_vector(named(vector)).alias(FEATURES), named(label).cast("double").alias(LABEL), WEIGHT)


def scorer(scoring: str = "f1") -> MulticlassClassificationEvaluator:
    if scoring not in SCORERS:
        raise ValueError(f"unknown scoring {scoring!r}; one of {sorted(SCORERS)}")
    return MulticlassClassificationEvaluator(
        labelCol=LABEL, predictionCol="prediction", metricName=SCORERS[scoring], metricLabel=1.0
    )


def _core(estimator: Estimator) -> Estimator:
    return estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator


def total_weight(train: DataFrame) -> float:
    return float(train.agg(F.sum(WEIGHT)).head()[0])


def _validator(estimator, maps, scoring, k, parallelism):
    return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=scorer(scoring), numFolds=k,
                          foldCol=FOLD, parallelism=parallelism, seed=C.SEED)


def _map(folded: DataFrame, mapping: kernels.FourierFeatures, k: int, parallelism: int) -> machines.Map:
    """The map as it is fitted without each fold."""
    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(inheritable_thread_target(folded.sparkSession)(lambda f: mapping.fit(folded.where(F.col(FOLD) != f))), range(k)))
    first = fitted[0]
    widths = tuple(math.sqrt(2 * m.getOrDefault("gamma")) for m in fitted)
    return machines.Map(first.getOrDefault("seed"), first.getOrDefault("wide"), first.getOrDefault("frequencies"), widths)


def _fitted_together(folded: DataFrame, estimator: Estimator, strengths: list[float], k: int, parallelism: int, start=None):
    """(models by fold and strength, counts of hits, map or None) of a linear model; None where the fits cannot run side by side."""
    columns = (FEATURES, LABEL, WEIGHT, FOLD)
    if isinstance(estimator, LogisticRegression):
        found = logistic.fold_models(folded, strengths, k, estimator.getMaxIter(), *columns)
        return found and (*found, None)
    mapping, machine = estimator.getStages() if isinstance(estimator, Pipeline) else (None, estimator)
    if not isinstance(machine, LinearSVC):
        return None
    kernel = mapping and _map(folded, mapping, k, parallelism)
    found = machines.fold_models(folded, strengths, k, machine.getMaxIter(), *columns, kernel, start)
    return found and (*found, kernel)


def _scores_together(folded: DataFrame, estimator: Estimator, strengths: list[float], scoring: str, k: int, parallelism: int) -> list[list[float]] | None:
    """A score by fold and strength; None where the fits cannot run side by side (see `logistic.fold_models`, `machines.fold_models`)."""
    found = _fitted_together(folded, estimator, strengths, k, parallelism)
    if found is None:
        return None
    spark, judge = folded.sparkSession, scorer(scoring).setWeightCol("n")

    def score(model):
        counts = [tuple(r)[1:] for r in found[1] if r["model"] == model]
        if not counts:
            raise ValueError(f"The validation data at fold {model // len(strengths)} is empty.")
        return float(judge.evaluate(spark.createDataFrame(counts, "label double, prediction double, n double").coalesce(1)))

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(inheritable_thread_target(spark)(score), range(k * len(strengths))))
    return [scores[f * len(strengths):(f + 1) * len(strengths)] for f in range(k)]


def fold_scores(train: DataFrame, key: str, names: list[str] | None = None, scoring: str = "f1", k: int = C.FOLDS,
                settings: dict[str, dict] | None = None, parallelism: int = 4) -> DataFrame:
    """(model, fold, score, seconds): every candidate on the same stratified folds, several fits at a time.

    The folds of a logistic regression or a machine are fitted together and share their time evenly.
    """
    models = catalog()
    names = names or list(models)
    folded = split.folds(train, LABEL, key, k).persist()
    weight = total_weight(train)  # as in the grid search, so that both rank the same models
    judge = scorer(scoring)

    def one(task):
        name, fold = task
        estimator = models[name].build(weight, **(settings or {}).get(name, {}))
        begin = time.time()
        fitted = estimator.fit(folded.where(F.col(FOLD) != fold))
        score = judge.evaluate(fitted.transform(folded.where(F.col(FOLD) == fold)))
        return name, fold, float(score), time.time() - begin

    rows, single = [], []
    try:
        for name in names:
            estimator = models[name].build(weight, **(settings or {}).get(name, {}))
            begin = time.time()
            core = _core(estimator)
            together = _scores_together(folded, estimator, [core.getRegParam()], scoring, k, parallelism) if isinstance(core, (LogisticRegression, LinearSVC)) else None
            if together is None:
                single.append(name)
            else:
                rows += [(name, fold, scores[0], (time.time() - begin) / k) for fold, scores in enumerate(together)]
        tasks = [(name, fold) for name in single for fold in range(k)]
        with ThreadPoolExecutor(parallelism) as pool:
            rows += pool.map(inheritable_thread_target(train.sparkSession)(one), tasks)
    finally:
        folded.unpersist()
    return train.sparkSession.createDataFrame(rows, "model string, fold int, score double, seconds double")


def cross_validate(train: DataFrame, key: str, names: list[str] | None = None, scoring: str = "f1", k: int = C.FOLDS,
                   settings: dict[str, dict] | None = None) -> DataFrame:
    """(model, mean_score, std_score, min_score, max_score, time_seconds), best first."""
    return evaluate.cv_summary(fold_scores(train, key, names, scoring, k, settings), seconds="seconds")


def param_maps(name: str, estimator: Estimator, grid: dict, weight: float) -> list[dict]:
    """The grid in the parameter names of the estimator."""
    e = estimator
    names = {
        "trees": "numTrees" if name == "RandomForest" else "maxIter", "depth": "maxDepth", "min_split": "minInstancesPerNode",
        "rate": "stepSize", "subsample": "subsamplingRate", "colsample": "featureSubsetStrategy", "C": "regParam",
    }
    convert = {
        "depth": lambda v: v or MAX_DEPTH, "min_split": lambda v: max(1, v // 2),
        "colsample": lambda v: "all" if v == 1.0 else str(v), "C": lambda v: 1.0 / (v * weight),
    }
    builder = ParamGridBuilder()
    for key, values in grid.items():
        # two settings may mean the same to Spark; it is tried once
        builder = builder.addGrid(e.getParam(names[key]), list(dict.fromkeys(convert.get(key, lambda v: v)(v) for v in values)))
    return builder.build()


def train_best(train: DataFrame, key: str, name: str | None = None, scoring: str = "f1", k: int = C.FOLDS,
               grids: dict[str, dict] | None = None, settings: dict[str, dict] | None = None, parallelism: int = 4,
               candidates: list[str] | None = None):
    """(model, cv table or None, best parameters): tune by grid and refit on all rows.

    Without a name the best of `candidates` (the whole catalog if not given) by cross-validation is taken.
    """
    models = catalog()
    if name is not None and name not in models:
        raise ValueError(f"unknown model {name!r}; one of {sorted(models)}")
    cv = None if name else cross_validate(train, key, candidates, scoring, k, settings)
    if cv is not None:
        name = evaluate.best_model(cv).head()["model"]
    candidate = models[name]
    weight = total_weight(train)
    grid = dict((grids or {}).get(name, candidate.grid))
    variants = [{"kernel": v} for v in grid.pop("kernel", ())] or [{}]
    folded = split.folds(train, LABEL, key, k).persist()
    found = []  # score, estimator, setting, parameters, model if it is there already
    try:
        for variant in variants:
            estimator = candidate.build(weight, **{**(settings or {}).get(name, {}), **variant})
            core = _core(estimator)
            maps = param_maps(name, core, grid, weight)
            together, tuned = None, None
            if isinstance(core, (LogisticRegression, LinearSVC)) and set(grid) == {"C"}:
                together = _scores_together(folded, estimator, [m[core.regParam] for m in maps], scoring, k, parallelism)
            if together is None:
                tuned: CrossValidatorModel = _validator(estimator, maps, scoring, k, parallelism).fit(folded)
                scores = tuned.avgMetrics
            else:
                scores = [sum(column) / k for column in zip(*together)]
            best = max(range(len(maps)), key=lambda i: scores[i])
            found.append((scores[best], estimator, maps[best], {**{p.name: v for p, v in maps[best].items()}, **variant}, tuned and tuned.bestModel))
        _, estimator, chosen, params, model = max(found, key=lambda f: f[0])
        model = model or estimator.fit(folded, chosen)
    finally:
        folded.unpersist()
    return model, cv, params


def calibrated_svm(train: DataFrame, key: str, estimator: Estimator, k: int = C.FOLDS, fitted: Model | None = None, parallelism: int = 4) -> PipelineModel:
    """A machine with probabilities: a logistic curve fitted on out-of-fold margins (Platt). `fitted` is it on all rows, if there is one.

    The folds are fitted together, beginning at `fitted`. Without it, or where that form does not apply, several single fits run at a
    time: one is a row of hundreds of short jobs, between which most of the cluster would wait.
    """
    folded = split.folds(train, LABEL, key, k).persist()

    def one(fold):
        if fold is None:
            return fitted or estimator.fit(folded)
        return estimator.fit(folded.where(F.col(FOLD) != fold))

    try:
        together = None
        if fitted is not None:
            core = fitted.stages[-1] if isinstance(fitted, PipelineModel) else fitted
            start = [*core.coefficients.toArray(), core.intercept]
            together = _fitted_together(folded, estimator, [_core(estimator).getRegParam()], k, parallelism, start)
        if together is not None:
            points, _, kernel = together
            whole, margins = fitted, materialize(machines.margins(folded, points, FEATURES, LABEL, WEIGHT, FOLD, kernel), "margins")
        else:
            with ThreadPoolExecutor(parallelism) as pool:
                *singles, whole = pool.map(inheritable_thread_target(train.sparkSession)(one), [*range(k), None])
            margins = None
            for fold, machine in enumerate(singles):
                part = machine.transform(folded.where(F.col(FOLD) == fold)).select(LABEL, "rawPrediction")
                margins = part if margins is None else margins.unionByName(part)
        curve = LogisticRegression(featuresCol="rawPrediction", labelCol=LABEL, probabilityCol="probability",
                                   rawPredictionCol="_curve_raw", predictionCol="_curve_prediction").fit(margins)
    finally:
        folded.unpersist()
    return PipelineModel([whole, curve])


def importance(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance), largest first: what a tree model splits by, or the size of a linear model's coefficients.

    Empty for models that have neither.
    """
    vectors = [(name, getattr(model, name, None)) for name in ("featureImportances", "coefficients")]
    weights = next((v.toArray() for _, v in vectors if v is not None), ())
    rows = [(c, abs(float(w))) for c, w in zip(columns, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _by_correlation(df: DataFrame, columns: list[str], label: str, trees: int) -> DataFrame:
    return profile.correlation_with(df, columns, label).select(F.col("column").alias("feature"), F.col("abs_corr").alias("rank"))


def _by_forest(df: DataFrame, columns: list[str], label: str, trees: int) -> DataFrame:
    forest = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=10, seed=C.SEED)
    found = importance(forest.fit(assemble(df, columns, label)), columns, df.sparkSession)
    return found.withColumnRenamed("importance", "rank")


RANKINGS = {"correlation": _by_correlation, "importance": _by_forest}


def select_features(df: DataFrame, columns: list[str], label: str, method: str = "importance",
                    top_k: int | None = None, trees: int = 100) -> list[str]:
    """Names of the features to keep: the `top_k` first by a ranking, all of them for `all` or without `top_k`."""
    if method not in (*RANKINGS, "all"):
        raise ValueError(f"unknown method {method!r}")
    if top_k is None or method not in RANKINGS:
        return [*columns]
    ranked = RANKINGS[method](df, columns, label, trees).where("rank IS NOT NULL")
    return [r["feature"] for r in ranked.orderBy(F.desc("rank"), "feature").limit(top_k).collect()]
