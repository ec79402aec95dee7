"""Score tables and files with a fitted preparation and model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.operators import contract, score
from cohortlens.operators.models import FEATURES
from cohortlens.plans.prepare import Preparation
from cohortlens.session import materialize
from cohortlens.sources import files, logs


@dataclass
class Scorer:
    """One preparation and one model: the same steps in training, batch and stream."""

    preparation: Preparation
    model: object
    model_type: str

    def predict(self, df: DataFrame, keep: list[str], timestamp: str | Column | None, zero: bool = False) -> DataFrame:
        """Prediction records for every row; `keep` columns ride along unchanged."""
        inputs = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_keep")
        matrix = self.preparation.transform(df.withColumn("_keep", inputs), ["_keep"], zero)
        vector = VectorAssembler(inputCols=self.preparation.columns, outputCol=FEATURES, handleInvalid="error")
        predicted = self.model.transform(vector.transform(matrix).select("_keep", FEATURES))
        scored = score.from_model(predicted, self.model_type, timestamp, ["_keep"])
        return scored.select("_keep.*", *[c for c in scored.columns if c != "_keep"])

    def save(self, path: str) -> str:
        self.preparation.save(f"{path}/preparation")
        wrapped = self.model if isinstance(self.model, PipelineModel) else PipelineModel([self.model])
        wrapped.write().overwrite().save(f"{path}/model")
        spark = self.preparation.classes.sparkSession
        spark.createDataFrame([(self.model_type,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model_type")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        if not logs.exists(spark, f"{path}/model"):
            raise FileNotFoundError(f"no model at {path}")
        return cls(
            Preparation.load(spark, f"{path}/preparation"),
            PipelineModel.load(f"{path}/model"),
            spark.read.text(f"{path}/model_type").head()[0],
        )


def score_valid(scorer: Scorer, df: DataFrame, keep: list[str], timestamp: str | Column | None) -> tuple[DataFrame, DataFrame]:
    """(prediction records of rows within bounds, quarantined rows with their violations)."""
    rules = contract.panel_rules(df.columns, scorer.preparation.spec.years)
    valid, quarantine = contract.split(df, rules)
    return scorer.predict(valid, keep, timestamp), quarantine


def score_file(spark: SparkSession, scorer: Scorer, source: str, result: str, log: str | None = None,
               timestamp: str | Column | None = None, quarantine: str | None = None) -> DataFrame:
    """CSV in, CSV out with three more columns, rows logged; returns total and counts by risk level.

    Records out of bounds are not scored; they go to the folder `quarantine` with their violations if one is given,
    and are an error otherwise. Scores are written once, and file and log both come from there.
    """
    inputs = files.read_csv(spark, source)
    valid, rejected = contract.split(inputs, contract.panel_rules(inputs.columns, scorer.preparation.spec.years))
    if quarantine:
        rejected.write.mode("overwrite").json(quarantine)
    elif not rejected.isEmpty():
        raise ValueError(f"{source} has records out of bounds and there is no quarantine folder for them")
    scored = materialize(scorer.predict(valid, inputs.columns, timestamp), "scored")
    flat = scored.select(
        *[F.col(f"`{c}`") for c in inputs.columns], "prediction", "risk_level",
        F.col("probability.at_risk").alias("probability_at_risk"),
    )
    files.write_csv(flat, result)
    if log:
        logs.append(logs.prediction_rows(scored, inputs.columns), log)
    return score.batch_summary(files.read_csv(spark, result, schema=flat.schema, sep=","))
