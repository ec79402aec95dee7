"""Evaluation of binary scores: matrix, metrics, report, curves and area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens import constants as C
from cohortlens.functions.labels import class_name
from cohortlens.functions.numeric import named
from cohortlens.operators.ranks import prefix_sums


def _over(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: true_negatives, false_positives, false_negatives, true_positives."""
    y, p = named(label), named(prediction)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )


def confusion_long(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, n) for any number of classes."""
    return df.groupBy(named(label).alias("actual"), named(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_normalized(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, share) with shares of the actual class."""
    cells = confusion_long(df, label, prediction)
    row = F.sum("n").over(Window.partitionBy("actual"))  # one row per predicted class
    return cells.select("actual", "predicted", (F.col("n").cast("double") / row).alias("share"))


def _metrics(cells: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    return cells.select(
        "*",
        _over(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: the matrix cells and accuracy, precision, recall and F1 of class 1."""
    return _metrics(confusion(df, label, prediction))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, n_pos, n_neg): everything the curves need, at most one row per distinct score."""
    y = named(label)
    return df.where(y.isNotNull() & named(score).isNotNull()).groupBy(named(score).alias("score")).agg(
        F.count_if(y == 1).alias("n_pos"), F.count_if(y != 1).alias("n_neg")
    )


def ranked_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """Score counts with running counts from the lowest score up."""
    return prefix_sums(score_counts(df, label, score), [], "score", ["n_pos", "n_neg"])


def auc_from(ranked: DataFrame) -> DataFrame:
    below = F.col("cum_n_neg") - F.col("n_neg")
    wins = F.sum(F.col("n_pos").cast("double") * (below.cast("double") + 0.5 * F.col("n_neg")))
    pairs = F.max("tot_n_pos").cast("double") * F.max("tot_n_neg")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("auc_roc"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs that the score orders right, ties half; null for one class."""
    return auc_from(ranked_scores(df, label, score))


def _descending(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "score", "tot_n_pos", "tot_n_neg",
        (F.col("tot_n_pos") - F.col("cum_n_pos") + F.col("n_pos")).alias("tp"),
        (F.col("tot_n_neg") - F.col("cum_n_neg") + F.col("n_neg")).alias("fp"),
    )


def roc_from(ranked: DataFrame) -> DataFrame:
    points = _descending(ranked).select(
        F.col("score").alias("threshold"), _over(F.col("fp"), F.col("tot_n_neg")).alias("fpr"),
        _over(F.col("tp"), F.col("tot_n_pos")).alias("tpr"),
    )
    start = points.sparkSession.range(1).selectExpr("cast(NULL AS double) AS threshold", "0D AS fpr", "0D AS tpr")
    return points.unionByName(start)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the origin without a threshold."""
    return roc_from(ranked_scores(df, label, score))


def pr_from(ranked: DataFrame) -> DataFrame:
    points = _descending(ranked).select(
        F.col("score").alias("threshold"), _over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _over(F.col("tp"), F.col("tot_n_pos")).alias("recall"),
    )
    end = points.sparkSession.range(1).selectExpr("cast(NULL AS double) AS threshold", "1D AS precision", "0D AS recall")
    return points.unionByName(end)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end point (1, 0)."""
    return pr_from(ranked_scores(df, label, score))


def classification_report(df: DataFrame, label: str, prediction: str, names=C.CLASS_NAMES) -> DataFrame:
    """(class, precision, recall, f1_score, support): a row per class, accuracy, macro and weighted averages."""
    cells = confusion_long(df, label, prediction)
    per_class = (
        cells.select(
            F.inline(F.array(
                F.struct(F.col("actual").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("hits")),
            ))
        )
        .groupBy("c")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .select(
            "c", "support", "hits", _over(F.col("hits"), F.col("predicted")).alias("precision"),
            _over(F.col("hits"), F.col("support")).alias("recall"),
            _over(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1_score"),
        )
    )
    measures = ("precision", "recall", "f1_score")
    rows = per_class.select(class_name(F.col("c"), names).alias("class"), *measures, "support")
    accuracy = _over(F.sum("hits"), F.sum("support"))
    totals = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_over(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
        accuracy.alias("accuracy"), F.sum("support").alias("support"),
    )
    averages = totals.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in measures], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{m}").alias(m) for m in measures], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{m}").alias(m) for m in measures], "support"),
    )))
    return rows.unionByName(averages)


def report_text(report: DataFrame) -> str:
    """The report as an aligned text table; it has one row per class and three averages."""
    rows = sorted(report.collect(), key=lambda r: (r["class"] in ("accuracy", "macro avg", "weighted avg"), r["class"]))
    lines = [f"{'':>16}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}", ""]
    for r in rows:
        if r["class"] == "accuracy":
            lines += ["", f"{'accuracy':>16}{'':>22}{r['f1_score']:>11.2f}{r['support']:>11}"]
        else:
            lines.append(
                f"{r['class']:>16}{r['precision']:>11.2f}{r['recall']:>11.2f}{r['f1_score']:>11.2f}{r['support']:>11}"
            )
    return "\n".join(lines) + "\n"


def evaluation(df: DataFrame, label: str, prediction: str, score: str | None, model_type: str) -> DataFrame:
    """One row: metrics, matrix, area (null without a score column), model type and number of rows.

    The matrix counts the rows with label and prediction, as `binary_metrics` does, the area those with label and score,
    as `roc_curve` does. The data is grouped once by (score, label, prediction); both come from that.
    """
    y, p = named(label), named(prediction)
    if score is None:
        cells = confusion(df, label, prediction).withColumn("auc_roc", F.lit(None).cast("double"))
    else:
        value = F.nanvl(named(score).cast("double"), F.lit(None))
        scored = value.isNotNull()
        grouped = df.where(y.isNotNull()).groupBy(value.alias("score")).agg(
            F.count_if(scored & (y == 1)).alias("n_pos"),
            F.count_if(scored & (y != 1)).alias("n_neg"),
            F.count_if((y == 0) & (p == 0)).alias("n_tn"),
            F.count_if((y == 0) & (p == 1)).alias("n_fp"),
            F.count_if((y == 1) & (p == 0)).alias("n_fn"),
            F.count_if((y == 1) & (p == 1)).alias("n_tp"),
        )
        ranked = prefix_sums(grouped, [], "score", ["n_pos", "n_neg", "n_tn", "n_fp", "n_fn", "n_tp"])
        below = F.col("cum_n_neg") - F.col("n_neg")
        wins = F.sum(F.col("n_pos").cast("double") * (below.cast("double") + 0.5 * F.col("n_neg")))
        pos, neg = F.max("tot_n_pos"), F.max("tot_n_neg")
        cells = ranked.agg(
            F.max("tot_n_tn").alias("true_negatives"),
            F.max("tot_n_fp").alias("false_positives"),
            F.max("tot_n_fn").alias("false_negatives"),
            F.max("tot_n_tp").alias("true_positives"),
            F.when((pos > 0) & (neg > 0), wins / (pos.cast("double") * neg)).alias("auc_roc"),
        )
    size = F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_positives")
    return _metrics(cells.withColumn("n_test_samples", size)).withColumn("model_type", F.lit(model_type))


def matrix_array(cells: DataFrame) -> DataFrame:
    """Add `matrix`: [[tn, fp], [fn, tp]] for export."""
    return cells.withColumn(
        "matrix",
        F.array(F.array("true_negatives", "false_positives"), F.array("false_negatives", "true_positives")),
    )


def cv_summary(scores: DataFrame, model: str = "model", score: str = "score", seconds: str | None = None) -> DataFrame:
    """Fold scores to (model, mean, population deviation, min, max), best first."""
    extra = [F.round(F.sum(named(seconds)), 2).alias("time_seconds")] if seconds else []
    return (
        scores.groupBy(named(model).alias("model"))
        .agg(
            F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
            F.min(score).alias("min_score"), F.max(score).alias("max_score"), *extra,
        )
        .orderBy(F.desc("mean_score"), "model")
    )


def best_model(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("mean_score"), "model").limit(1)


def top_importance(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
