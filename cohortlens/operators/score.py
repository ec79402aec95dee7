"""Scores from a fixed linear rule or a fitted model, as columns beside the inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.functions import vector_to_array

from cohortlens.functions.labels import risk_level
from cohortlens.functions.numeric import half_even, named, or_zero
from cohortlens.functions.times import moment

# Weights of the linear risk rule and its cut without the noise term.
RULE_WEIGHTS = {"INDE": 0.4, "IAA": 0.3}
RULE_CUT = 3.5


def linear_risk(df: DataFrame, year: int) -> DataFrame:
    """Add `risk`, `prediction` and `risk_level` from the fixed weights; a null score counts as 0."""
    parts = [(10.0 - or_zero(named(f"{s}_{year}"))) * w for s, w in RULE_WEIGHTS.items()]
    scored = df.withColumn("risk", parts[0] + parts[1])
    return scored.withColumn("prediction", F.when(F.col("risk") > RULE_CUT, 1).otherwise(0)).withColumn(
        "risk_level", risk_level(F.col("prediction"))
    )


def from_model(predicted: DataFrame, model_type: str, timestamp: str | Column | None, keep: list[str]) -> DataFrame:
    """Model output in the shape of a prediction record; every row of a run carries the same time."""
    p = vector_to_array("probability")
    return predicted.select(
        *[named(k) for k in keep],
        F.col("prediction").cast("int").alias("prediction"),
        risk_level(F.col("prediction")).alias("risk_level"),
        F.struct(half_even(p[0], 4).alias("no_risk"), half_even(p[1], 4).alias("at_risk")).alias("probability"),
        F.lit(model_type).alias("model_type"),
        moment(timestamp).alias("timestamp"),
    )


def responses(scored: DataFrame) -> DataFrame:
    """The public part of a prediction record, without the inputs."""
    return scored.select("prediction", "risk_level", "probability", "model_type", "timestamp")


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: total, n_high, n_low."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_level") == "HIGH").alias("n_high"),
        F.count_if(F.col("risk_level") == "LOW").alias("n_low"),
    )


def attach(inputs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores that arrive separately, joined to their inputs by key instead of by position."""
    return inputs.join(scores, key, "left")
