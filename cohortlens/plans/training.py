"""The training job: prepare, select, tune, evaluate, persist, log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens import constants as C
from cohortlens.operators import evaluate, models
from cohortlens.operators.kernel import FourierFeatures
from cohortlens.plans import prepare
from cohortlens.plans.scoring import Scorer
from cohortlens.session import materialize
from cohortlens.sources import logs
from cohortlens.spec import PanelSpec


@dataclass
class Outcome:
    scorer: Scorer
    cv: DataFrame | None
    params: dict
    evaluation: DataFrame
    importance: DataFrame
    report: DataFrame
    predictions: DataFrame


@dataclass
class TrainJob:
    """`grids` and `settings` replace parts of the catalog by model name.

    `model=None` picks the best of `candidates`, the whole catalog if not given, by cross-validation.
    """

    spark: SparkSession
    spec: PanelSpec
    out: str | None = None
    model: str | None = None
    scoring: str = "f1"
    folds: int = C.FOLDS
    missing: str = "median"
    fit_on: str = "train"
    grids: dict | None = None
    settings: dict | None = None
    candidates: list[str] | None = None
    timestamp: str | Column | None = None

    def run(self, df: DataFrame, year: int | None = None) -> Outcome:
        matrix, prep = prepare.prepare(df, self.spec, year, self.missing, True, self.fit_on)
        key, label = self.spec.key, prepare.LABEL
        # the encoded rows are written; scaling is a projection on them, which the fits keep in memory and the predictions read once
        train = models.assemble(matrix.where(F.col(prepare.SPLIT) == "train"), prep.columns, label, [key])
        best, cv, params = models.train_best(
            train, key, self.model, self.scoring, self.folds, self.grids, self.settings, candidates=self.candidates
        )
        core = best.stages[-1] if isinstance(best, PipelineModel) else best
        name = type(core).__name__
        fitted = models.calibrated_svm(train, key, _refit(best), self.folds, best) if name == "LinearSVCModel" else best
        scorer = Scorer(prep, fitted, name)

        test = models.assemble(matrix.where(F.col(prepare.SPLIT) == "test"), prep.columns, label, [key])
        from pyspark.ml.functions import vector_to_array

        predictions = materialize(
            fitted.transform(test).select(
                key, F.col(models.LABEL).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                vector_to_array("probability")[1].alias("y_proba"),
            ),
            "predictions",
        )
        evaluation = materialize(evaluate.evaluation(predictions, "y_true", "y_pred", "y_proba", name), "evaluation")
        importance = models.importance(best, prep.columns, self.spark)
        report = evaluate.classification_report(predictions, "y_true", "y_pred")
        outcome = Outcome(scorer, cv, params, evaluation, importance, report, predictions)
        if self.out:
            self.persist(outcome)
        return outcome

    def persist(self, outcome: Outcome) -> None:
        """Model and statistics, the JSON report and a row of the metrics log below `out`."""
        outcome.scorer.save(f"{self.out}/scorer")
        logs.write_report(report_row(outcome), f"{self.out}/evaluation_report")
        logs.append(logs.metrics_row(outcome.evaluation, outcome.scorer.model_type, self.timestamp), f"{self.out}/model_metrics")


def _refit(model):
    """An estimator with the parameters of a fitted machine, behind its kernel map if it has one."""
    if isinstance(model, PipelineModel):
        mapping = model.stages[0]
        names = ("inputCol", "outputCol", "frequencies", "gamma", "seed")
        return Pipeline(stages=[FourierFeatures(**{n: mapping.getOrDefault(n) for n in names}), _refit(model.stages[-1])])
    names = ("featuresCol", "labelCol", "weightCol", "standardization", "regParam", "maxIter")
    return LinearSVC(**{n: model.getOrDefault(n) for n in names})


def report_row(outcome: Outcome) -> DataFrame:
    """The evaluation report as one row of the report schema."""
    spark = outcome.evaluation.sparkSession
    text = evaluate.report_text(outcome.report)
    top = [(r["feature"], r["importance"]) for r in outcome.importance.collect()]
    kind = "feature_importance array<struct<feature string, importance double>>"
    extra = spark.createDataFrame([(top,)], kind)
    cells = evaluate.matrix_array(outcome.evaluation)
    return cells.select(
        F.struct(*[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1_score", "auc_roc")]).alias("metrics"),
        F.struct("matrix", "true_negatives", "false_positives", "false_negatives", "true_positives").alias("confusion_matrix"),
        F.lit(text).alias("classification_report"),
        extra.scalar().alias("feature_importance"),
        "model_type",
        "n_test_samples",
    )
