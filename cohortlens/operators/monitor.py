"""Statistics of the prediction log and the monitoring summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.numeric import divide, half_even, named

MIN_PREDICTIONS = 10


def latest(log: DataFrame, n: int, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest n log rows; each task keeps its own top n."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(n)


def risk_distribution(log: DataFrame) -> DataFrame:
    """(risk_level, n), most frequent first."""
    counts = log.where("risk_level is not null").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "risk_level")


def stats(log: DataFrame, last_n: int | None = None) -> DataFrame:
    """One row: total, counts of HIGH and LOW and of every level there is, mean probability, time of the last prediction.

    `risk_distribution` is an array of (risk_level, n) by level, so no level is lost whatever it is called.
    """
    rows = latest(log, last_n) if last_n else log
    levels = rows.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("probability_at_risk").alias("s"), F.count("probability_at_risk").alias("k"), F.max("timestamp").alias("t"))
    own = F.when(F.col("risk_level").isNotNull(), F.struct("risk_level", "n"))
    return levels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum(F.when(F.col("risk_level") == "HIGH", F.col("n"))), F.lit(0)).alias("n_high"),
        F.coalesce(F.sum(F.when(F.col("risk_level") == "LOW", F.col("n"))), F.lit(0)).alias("n_low"),
        divide(F.sum("s"), F.sum("k")).alias("avg_probability_at_risk"),
        F.max("t").alias("latest_prediction"),
        F.sort_array(F.collect_list(own)).alias("risk_distribution"),
    )


def latest_record(table: DataFrame, time: str = "timestamp", tie: str | None = None) -> DataFrame:
    """The last row of a log, found by a single aggregate."""
    order = F.struct(time, tie) if tie else F.col(time)
    return table.agg(F.max_by(F.struct(*table.columns), order).alias("r")).select("r.*")


def drift_gate(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1,
               minimum: int = MIN_PREDICTIONS) -> DataFrame:
    """Verdict on the current predictions; null with a message while there are fewer than `minimum`."""
    sides = reference.select(F.lit(True).alias("is_ref"), named(column).alias("v")).unionByName(
        current.select(F.lit(False).alias("is_ref"), named(column).alias("v"))
    )
    means = sides.agg(
        F.count_if(~F.col("is_ref")).alias("total_predictions"),
        F.avg(F.when(F.col("is_ref"), F.col("v"))).alias("rm"),
        F.avg(F.when(~F.col("is_ref"), F.col("v"))).alias("cm"),
    )
    enough = F.col("total_predictions") >= minimum
    return means.select(
        "total_predictions",
        F.when(enough, F.abs(F.col("cm") - F.col("rm")) > threshold).alias("drift_detected"),
        F.when(enough, "drift monitoring active").otherwise("not enough predictions").alias("message"),
    )


def metrics_view(report: DataFrame, log: DataFrame) -> DataFrame:
    """One row: model type, metrics, matrix, importance and size of the last evaluation beside the log statistics.

    The evaluation part is null while there is no report.
    """
    last = report.select(F.struct(
        "model_type", "metrics", "n_test_samples", "confusion_matrix", "feature_importance"
    )).limit(1).scalar()
    both = stats(log).select(F.struct("*").alias("prediction_stats"), last.alias("_r"))
    return both.select(
        F.coalesce("_r.model_type", F.lit("unknown")).alias("model_type"), "_r.metrics", "prediction_stats",
        "_r.n_test_samples", "_r.confusion_matrix", "_r.feature_importance",
    )


def summary(log: DataFrame, metrics: DataFrame | None = None, evaluation: DataFrame | None = None) -> DataFrame:
    """One row: log statistics, the newest metrics row and the evaluation metrics, each as a struct."""
    empty = F.col("total_predictions") == 0
    totals = stats(log).select(
        F.lit("active").alias("status"), "total_predictions", "n_high", "n_low", "risk_distribution",
        half_even(F.col("avg_probability_at_risk"), 4).alias("avg_risk_probability"), "latest_prediction",
        F.when(empty, "no predictions logged yet").alias("message"),
    )
    extra = []
    if metrics is not None:
        extra.append(latest_record(metrics).select(F.struct("*")).scalar().alias("latest_model_metrics"))
    if evaluation is not None:
        extra.append(evaluation.select(F.struct("*")).limit(1).scalar().alias("evaluation_metrics"))
    return totals.select("*", *extra)
