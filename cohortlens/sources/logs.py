"""Append-only prediction, metrics and drift logs, and the evaluation report file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortlens.functions.numeric import named
from cohortlens.functions.times import moment

# The three log tables and the report.
PREDICTION_LOG = (
    "timestamp timestamp, input_data string, prediction int, risk_level string, probability_at_risk double, model_type string"
)
METRICS_LOG = (
    "timestamp timestamp, model_type string, accuracy double, precision_score double, recall double, f1_score double, "
    "auc_roc double"
)
DRIFT_LOG = (
    "timestamp timestamp, drift_detected boolean, drifted_features array<string>, n_features_analyzed bigint, "
    "n_features_drifted bigint, report_path string"
)
REPORT = (
    "metrics struct<accuracy double, precision double, recall double, f1_score double, auc_roc double>, "
    "confusion_matrix struct<matrix array<array<bigint>>, true_negatives bigint, false_positives bigint, "
    "false_negatives bigint, true_positives bigint>, "
    "classification_report string, feature_importance array<struct<feature string, importance double>>, "
    "model_type string, n_test_samples bigint"
)


# Log times keep their microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def prediction_rows(scored: DataFrame, inputs: list[str], timestamp: str | Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Scored rows in the shape of the prediction log, then the columns `keep`; null inputs do not appear in the JSON text."""
    have = set(scored.columns)
    at_risk = F.col("probability.at_risk") if "probability" in have else F.lit(None)
    return scored.select(
        moment(timestamp if timestamp is not None else F.col("timestamp")).alias("timestamp"),
        F.to_json(F.struct(*[named(c) for c in inputs])).alias("input_data"),
        F.col("prediction").cast("int").alias("prediction"),
        "risk_level",
        at_risk.cast("double").alias("probability_at_risk"),
        (F.col("model_type") if "model_type" in have else F.lit(None).cast("string")).alias("model_type"),
        *[named(c) for c in keep],
    )


def append(rows: DataFrame, path: str, form: str = "json") -> None:
    """Append to a log folder with one partition folder per day."""
    rows.withColumn("log_date", F.to_date("timestamp")).write.mode("append").partitionBy("log_date").option(
        "timestampFormat", TIME_FORMAT
    ).format(form).save(path)


def metrics_row(metrics: DataFrame, model_type: str, timestamp: str | Column | None) -> DataFrame:
    """One row of binary metrics in the shape of the metrics log."""
    return metrics.select(
        moment(timestamp).alias("timestamp"), F.lit(model_type).alias("model_type"), "accuracy",
        F.col("precision").alias("precision_score"), "recall", "f1_score",
        (F.col("auc_roc") if "auc_roc" in metrics.columns else F.lit(None).cast("double")).alias("auc_roc"),
    )


def drift_row(summary: DataFrame, timestamp: str | Column | None, report_path: str | None = None) -> DataFrame:
    return summary.select(
        moment(timestamp).alias("timestamp"), "drift_detected", "drifted_features", "n_features_analyzed",
        "n_features_drifted", F.lit(report_path).cast("string").alias("report_path"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read(spark: SparkSession, path: str, schema: str = PREDICTION_LOG, form: str = "json", since: str | None = None) -> DataFrame:
    """A log as a frame; an empty one while nothing has been written. Blank lines are skipped.

    With `since` (a date) only the folders of that day and later ones are read.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    log = spark.read.schema(schema).option("timestampFormat", TIME_FORMAT).format(form).load(path)
    if since is not None:
        log = log.where(F.col("log_date") >= F.lit(since).cast("date"))
    return log.select(*StructType.fromDDL(schema).names)


def read_with_quarantine(spark: SparkSession, path: str, schema: str = PREDICTION_LOG) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, lines that are not valid JSON)."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value")
    full = schema + ", _corrupt_record string"
    parsed = lines.select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")
    return good, parsed.where("r._corrupt_record is not null").select("value")


def write_report(report: DataFrame, path: str) -> str:
    """A one-row evaluation report as JSON."""
    report.write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, REPORT)
