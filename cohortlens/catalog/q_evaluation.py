"""Evaluation of the labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.inputs import LABELS, LOG
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import evaluate
from cohortlens.sources import logs, star
from cohortlens.session import scratch_dir

CELLS = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS true_negatives, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS false_positives,
count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS false_negatives, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS true_positives"""
MEASURES = ", ".join([
    r6("coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0)", "accuracy"), r6("coalesce(tp / nullif(tp + fp, 0), 0)", "precision"),
    r6("coalesce(tp / nullif(tp + fn, 0), 0)", "recall"), r6("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1_score"),
])
SHORT = "SELECT true_negatives AS tn, false_positives AS fp, false_negatives AS fn, true_positives AS tp, * FROM M"
AUC = """G AS (SELECT y_proba AS s, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true <> 1) AS q FROM LB GROUP BY 1),
R AS (SELECT *, sum(q) OVER (ORDER BY s) - q AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp,
      sum(p) OVER () AS np, sum(q) OVER () AS nq FROM G)"""
AUC_VALUE = "(SELECT sum(p * (below + 0.5 * q)) / (max(np) * max(nq)) FROM R)"


def _lb(spark, d):
    return star.labelled_scores(spark, d)


@query("confusion_matrix", f"WITH {LABELS} SELECT {CELLS} FROM LB")
def confusion_matrix(spark, d):
    return evaluate.confusion(_lb(spark, d), "y_true", "y_pred")


@query("confusion_long", f"WITH {LABELS} SELECT y_true AS actual, y_pred AS predicted, count(*) AS n FROM LB GROUP BY ALL")
def confusion_long(spark, d):
    return evaluate.confusion_long(_lb(spark, d), "y_true", "y_pred")


@query("confusion_normalized", f"""WITH {LABELS}, G AS (SELECT y_true AS actual, y_pred AS predicted, count(*) AS n FROM LB GROUP BY ALL)
SELECT actual, predicted, {r6('n / sum(n) OVER (PARTITION BY actual)', 'share')} FROM G""")
def confusion_normalized(spark, d):
    return rounded(evaluate.confusion_normalized(_lb(spark, d), "y_true", "y_pred"))


@query("binary_metrics", f"""WITH {LABELS}, M AS (SELECT {CELLS} FROM LB), X AS ({SHORT})
SELECT true_negatives, false_positives, false_negatives, true_positives, {MEASURES} FROM X""")
def binary_metrics(spark, d):
    return rounded(evaluate.binary_metrics(_lb(spark, d), "y_true", "y_pred"))


@query("roc_auc", f"WITH {LABELS}, {AUC} SELECT {r6(AUC_VALUE, 'auc_roc')}")
def roc_auc(spark, d):
    return rounded(evaluate.roc_auc(_lb(spark, d), "y_true", "y_proba"))


@query("roc_curve", f"""WITH {LABELS}, {AUC}
SELECT {r6('s', 'threshold')}, {r6('fp / nq', 'fpr')}, {r6('tp / np', 'tpr')} FROM R
UNION ALL SELECT NULL, 0::DOUBLE, 0::DOUBLE""")
def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(_lb(spark, d), "y_true", "y_proba"))


@query("pr_curve", f"""WITH {LABELS}, {AUC}
SELECT {r6('s', 'threshold')}, {r6('tp / (tp + fp)', 'precision')}, {r6('tp / np', 'recall')} FROM R
UNION ALL SELECT NULL, 1::DOUBLE, 0::DOUBLE""")
def pr_curve(spark, d):
    return rounded(evaluate.pr_curve(_lb(spark, d), "y_true", "y_proba"))


_PER_CLASS = f"""{LABELS}, T AS (
  SELECT c, count(*) FILTER (WHERE y_true = c) AS support, count(*) FILTER (WHERE y_pred = c) AS predicted,
         count(*) FILTER (WHERE y_true = c AND y_pred = c) AS hits
  FROM LB, (SELECT DISTINCT y_true AS c FROM LB UNION SELECT DISTINCT y_pred FROM LB) GROUP BY c),
K AS (SELECT c, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r,
      coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f FROM T)"""


@query("classification_report", f"""WITH {_PER_CLASS}
SELECT CASE c WHEN 0 THEN 'Sem Risco (0)' WHEN 1 THEN 'Em Risco (1)' ELSE CAST(c AS VARCHAR) END AS class,
       {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f', 'f1_score')}, support FROM K
UNION ALL SELECT 'accuracy', {r6('sum(hits) / sum(support)')}, {r6('sum(hits) / sum(support)')}, {r6('sum(hits) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM K
UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f)')}, CAST(sum(support) AS BIGINT) FROM K
UNION ALL SELECT 'weighted avg', {r6('sum(p * support) / sum(support)')}, {r6('sum(r * support) / sum(support)')},
  {r6('sum(f * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM K""")
def classification_report(spark, d):
    return rounded(evaluate.classification_report(_lb(spark, d), "y_true", "y_pred"))


@query("evaluation_report", f"""WITH {LABELS}, {AUC}, M AS (SELECT {CELLS}, count(*) AS n_test_samples FROM LB), X AS ({SHORT})
SELECT true_negatives, false_positives, false_negatives, true_positives, {r6(AUC_VALUE, 'auc_roc')}, n_test_samples, {MEASURES},
       'fixed rule' AS model_type FROM X""")
def evaluation_report(spark, d):
    return rounded(evaluate.evaluation(_lb(spark, d), "y_true", "y_pred", "y_proba", "fixed rule"))


@query("report_file", f"""WITH {LABELS}, M AS (SELECT {CELLS} FROM LB), X AS ({SHORT})
SELECT {r6('coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0)', 'accuracy')}, true_positives, 'fixed rule' AS model_type FROM X""")
def report_file(spark, d):
    done = evaluate.evaluation(_lb(spark, d), "y_true", "y_pred", "y_proba", "fixed rule")
    row = evaluate.matrix_array(done).select(
        F.struct("accuracy", "precision", "recall", "f1_score", "auc_roc").alias("metrics"),
        F.struct("matrix", "true_negatives", "false_positives", "false_negatives", "true_positives").alias("confusion_matrix"),
        "model_type", "n_test_samples",
    )
    path = logs.write_report(row, scratch_dir(spark, "report"))
    back = logs.read_report(spark, path)
    return rounded(back.select("metrics.accuracy", "confusion_matrix.true_positives", "model_type"))


# Fold scores: the mean probability of each event type (as the model) in five groups of users (as the folds).
_FOLDS = f"{LOG}, S AS (SELECT model_type AS model, user_id % 5 AS fold, avg(probability_at_risk) AS score FROM EV GROUP BY 1, 2)"
_SUMMARY = "C AS (SELECT model, avg(score) AS m, stddev_pop(score) AS s, min(score) AS lo, max(score) AS hi FROM S GROUP BY model)"


def _fold_scores(spark, d):
    log = star.score_log(spark, d)
    return log.groupBy(F.col("model_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(
        F.avg("probability_at_risk").alias("score")
    )


@query("cv_summary", f"""WITH {_FOLDS}, {_SUMMARY}
SELECT model, {r6('m', 'mean_score')}, {r6('s', 'std_score')}, {r6('lo', 'min_score')}, {r6('hi', 'max_score')} FROM C""")
def cv_summary(spark, d):
    return rounded(evaluate.cv_summary(_fold_scores(spark, d)))


@query("cv_best_model", f"WITH {_FOLDS}, {_SUMMARY} SELECT model, {r6('m', 'mean_score')} FROM C ORDER BY m DESC, model LIMIT 1")
def cv_best_model(spark, d):
    best = evaluate.best_model(evaluate.cv_summary(_fold_scores(spark, d)))
    return rounded(best.select("model", "mean_score"))
