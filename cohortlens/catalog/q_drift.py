"""Drift and monitoring of the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.inputs import LABELS, LOG, SHIFTED
from cohortlens.catalog.q_evaluation import CELLS, MEASURES, SHORT
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import drift, evaluate, monitor, reference
from cohortlens.session import scratch_dir
from cohortlens.sources import files, logs, star
from cohortlens.sources.indexed import IndexedLog

CUT = "timestamp_ntz'2024-01-16'"
COLUMNS = ["p", "user_id", "high"]
TESTS = {"user_id": "ks", "high": "js_distance"}


def _sides(spark, d):
    """The log cut in the middle of the month; values of the second half are three times as large."""
    events = star.table(spark, d, "events")
    value = f"CASE WHEN ts < {CUT} THEN value ELSE value * 3 END"
    rows = events.selectExpr("ts", "user_id", "event_type", f"({value}) / (({value}) + 100.0D) AS p").withColumn(
        "high", F.when(F.col("p") >= 0.5, 1).otherwise(0)
    )
    keep = ["p", "user_id", "high", "event_type"]
    return rows.where(f"ts < {CUT}").select(*keep), rows.where(f"ts >= {CUT}").select(*keep)


_LONG = f"""{SHIFTED}, L AS (
  SELECT 'p' AS "column", p AS v, is_ref FROM SH UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE), is_ref FROM SH
  UNION ALL SELECT 'high', CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS DOUBLE), is_ref FROM SH),
G AS (SELECT "column", v, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM L GROUP BY 1, 2),
R AS (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY "column") AS tr,
      sum(c) OVER (PARTITION BY "column") AS tc, lead(v) OVER w AS nv,
      sum(r * v) OVER (PARTITION BY "column") / sum(r) OVER (PARTITION BY "column") AS mu
      FROM G WINDOW w AS (PARTITION BY "column" ORDER BY v)),
T0 AS (SELECT "column", CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur, count(*) AS n_values, max(abs(cr / tr - cc / tc)) AS ks,
       sum(abs(cr / tr - cc / tc) * (coalesce(nv, v) - v)) / greatest(sqrt(sum(r * (v - mu) * (v - mu)) / max(tr)), 0.001) AS w,
       sqrt(greatest(sum(0.5 * (CASE WHEN r > 0 THEN r / tr * log2(2 * (r / tr) / (r / tr + c / tc)) ELSE 0 END
         + CASE WHEN c > 0 THEN c / tc * log2(2 * (c / tc) / (r / tr + c / tc)) ELSE 0 END)), 0)) AS js
       FROM R GROUP BY "column"),
T1 AS (SELECT *, ks * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS x FROM T0),
T AS (SELECT *, CASE WHEN x < 0.3 THEN 1 ELSE least(greatest((SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
      * exp(-2.0::DOUBLE * j * j * x * x)) FROM range(1, 101) k(j)), 0), 1) END AS pv FROM T1)"""
_VERDICT = f"""{_LONG}, V AS (
  SELECT *, CASE "column" WHEN 'high' THEN 'js_distance' WHEN 'user_id' THEN 'ks' ELSE 'wasserstein' END AS test,
         CASE "column" WHEN 'high' THEN js WHEN 'user_id' THEN pv ELSE w END AS score,
         CASE "column" WHEN 'user_id' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS threshold FROM T),
U AS (SELECT *, CASE WHEN test = 'ks' THEN score < threshold ELSE score >= threshold END AS drift_detected FROM V)"""


@query("drift_ks", f'WITH {_LONG} SELECT "column", n_ref, n_cur, {r6("ks", "ks")}, {r6("pv", "ks_p_value")} FROM T')
def drift_ks(spark, d):
    return rounded(drift.ks(*_sides(spark, d), COLUMNS))


@query("drift_wasserstein", f'WITH {_LONG} SELECT "column", {r6("w", "wasserstein")} FROM T')
def drift_wasserstein(spark, d):
    return rounded(drift.wasserstein(*_sides(spark, d), COLUMNS))


@query("drift_report", f"""WITH {_VERDICT} SELECT "column", n_ref, n_cur, {r6('ks', 'ks')}, {r6('pv', 'ks_p_value')}, {r6('w', 'wasserstein')}, {r6('js', 'js_distance')},
       test, {r6('score', 'score')}, {r6('threshold', 'threshold')}, drift_detected FROM U""")
def drift_report(spark, d):
    return rounded(drift.report(*_sides(spark, d), test=TESTS))


@query("drift_summary", f"""WITH {_VERDICT}
SELECT coalesce(bool_or(drift_detected), false) AS drift_detected,
       coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected), '') AS drifted_features,
       count(*) AS n_features_analyzed, count(*) FILTER (WHERE drift_detected) AS n_features_drifted FROM U""")
def drift_summary(spark, d):
    return drift.summary(drift.report(*_sides(spark, d), test=TESTS)).withColumn("drifted_features", F.array_join("drifted_features", ","))


@query("drift_profile", f"""WITH {_LONG}
SELECT "column", CAST(count(*) FILTER (WHERE is_ref) AS BIGINT) AS n_ref, CAST(count(*) FILTER (WHERE NOT is_ref) AS BIGINT) AS n_cur, {r6('avg(v) FILTER (WHERE is_ref)', 'ref_mean')},
       {r6('stddev_pop(v) FILTER (WHERE is_ref)', 'ref_std')}, {r6('avg(v) FILTER (WHERE NOT is_ref)', 'cur_mean')}, true AS ks_within_error, true AS wasserstein_within_error FROM L GROUP BY 1""")
def drift_profile(spark, d):
    """The first half of the month as daily profiles, the second half checked against them; distances lie near the exact ones."""
    events = star.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before, after = _sides(spark, d)
    value = "value / (value + 100.0D)"
    old = events.where(f"ts < timestamp'2024-01-16'").selectExpr("ts", "user_id", f"{value} AS p").withColumn("high", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    path = scratch_dir(spark, "profile")
    reference.store(old, COLUMNS, "ts", path)
    found = reference.check(reference.load(spark, path), after, COLUMNS)
    exact = drift.report(before, after, COLUMNS).select("column", F.col("ks").alias("exact_ks"), F.col("wasserstein").alias("exact_wasserstein"))
    error = reference.ks_error()
    near = lambda name, by: (F.abs(F.col(name) - F.col(f"exact_{name}")) <= by).alias(f"{name}_within_error")
    return rounded(found.join(exact, "column").select(
        "column", "n_ref", "n_cur", "ref_mean", "ref_std", "cur_mean", near("ks", error), near("wasserstein", 3 * error)))


_EDGES = """E AS (SELECT "column", """ + ", ".join(
    f"quantile_cont(v, {i / 10!r}) FILTER (WHERE is_ref) AS e{i}" for i in range(1, 10)
) + """ FROM L GROUP BY "column"),
B AS (SELECT "column", """ + " + ".join(f"CASE WHEN e{i} < v THEN 1 ELSE 0 END" for i in range(1, 10)) + """ AS bin,
      count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM L JOIN E USING ("column") GROUP BY 1, 2),
H AS (SELECT "column", r / sum(r) OVER (PARTITION BY "column") AS a, c / sum(c) OVER (PARTITION BY "column") AS b FROM B)"""


@query("drift_psi", f"""WITH {_LONG}, {_EDGES}
SELECT "column", {r6('sum((greatest(b, 0.0001) - greatest(a, 0.0001)) * ln(greatest(b, 0.0001) / greatest(a, 0.0001)))', 'psi')} FROM H GROUP BY 1""")
def drift_psi(spark, d):
    return rounded(drift.psi(*_sides(spark, d), COLUMNS))


@query("drift_js", f"""WITH {_LONG}, {_EDGES}
SELECT "column", {r6('sqrt(greatest(sum(0.5 * (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END)), 0))', 'js_distance')}
FROM H GROUP BY 1""")
def drift_js(spark, d):
    return rounded(drift.js(*_sides(spark, d), COLUMNS))


@query("drift_chi2", f"""WITH {SHIFTED}, L AS (
  SELECT 'event_type' AS "column", event_type AS v, is_ref FROM SH
  UNION ALL SELECT 'high', CASE WHEN p >= 0.5 THEN '1' ELSE '0' END, is_ref FROM SH),
G AS (SELECT "column", v, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE NOT is_ref) AS c FROM L GROUP BY 1, 2),
X AS (SELECT *, sum(r) OVER w AS tr, sum(c) OVER w AS tc, (r + c) / CAST(sum(r + c) OVER w AS DOUBLE) AS share
      FROM G WINDOW w AS (PARTITION BY "column")),
S AS (SELECT "column", CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur, count(*) - 1 AS dof,
      sum((r - tr * share) * (r - tr * share) / (tr * share) + (c - tc * share) * (c - tc * share) / (tc * share)) AS x FROM X GROUP BY 1)
SELECT "column", n_ref, n_cur, {r6('x', 'chi2')}, dof, {r6('pv', 'p_value')}, pv < 0.05 AS drift_detected
FROM (SELECT *, CASE WHEN dof = 0 OR x <= 0 THEN 1.0::DOUBLE ELSE greatest(1 - (SELECT sum(exp((dof / 2 + i) * ln(x / 2) - x / 2 - lgamma(dof / 2 + i + 1))) FROM range(1000) t(i)), 0) END AS pv FROM S)""")
def drift_chi2(spark, d):
    return rounded(drift.chi2(*_sides(spark, d), ["event_type", "high"]))


@query("drift_moments", f"""WITH {_LONG}
SELECT "column", {r6('avg(v) FILTER (WHERE is_ref)', 'ref_mean')}, {r6('avg(v) FILTER (WHERE NOT is_ref)', 'cur_mean')},
       {r6('stddev_pop(v) FILTER (WHERE is_ref)', 'ref_std')}, {r6('stddev_pop(v) FILTER (WHERE NOT is_ref)', 'cur_std')},
       {r6('(avg(v) FILTER (WHERE NOT is_ref) - avg(v) FILTER (WHERE is_ref)) / nullif(stddev_pop(v) FILTER (WHERE is_ref), 0)', 'shift')}
FROM L GROUP BY 1""")
def drift_moments(spark, d):
    return rounded(drift.moments_shift(*_sides(spark, d), COLUMNS))


def _prediction_drift_sql(source, threshold):
    r4 = lambda e, a: f"round({e}, 4) + 0::DOUBLE AS {a}"
    return f"""X AS (SELECT avg(p) FILTER (WHERE is_ref) AS rm, avg(p) FILTER (WHERE NOT is_ref) AS cm,
  stddev_pop(p) FILTER (WHERE is_ref) AS rs, stddev_pop(p) FILTER (WHERE NOT is_ref) AS cs FROM {source})
SELECT abs(cm - rm) > {threshold} AS drift_detected, {r4('rm', 'reference_mean')}, {r4('cm', 'current_mean')}, {r4('abs(cm - rm)', 'mean_difference')},
       {r4('rs', 'reference_std')}, {r4('cs', 'current_std')}, {threshold}::DOUBLE AS threshold FROM X"""


@query("prediction_drift", f"WITH {SHIFTED}, {_prediction_drift_sql('SH', 0.1)}")
def prediction_drift(spark, d):
    return drift.prediction_drift(*_sides(spark, d), "p", 0.1)


@query("prediction_drift_none", f"""WITH {LOG}, U AS (SELECT probability_at_risk AS p, timestamp < TIMESTAMP '2024-01-16' AS is_ref FROM EV),
{_prediction_drift_sql('U', 0.1)}""")
def prediction_drift_none(spark, d):
    log = star.score_log(spark, d)
    is_ref = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    return drift.prediction_drift_sides(log, is_ref, ~is_ref, "probability_at_risk", 0.1)


@query("drift_gate", f"""WITH {SHIFTED}
SELECT count(*) FILTER (WHERE NOT is_ref) AS total_predictions,
       CASE WHEN count(*) FILTER (WHERE NOT is_ref) >= 10 THEN abs(avg(p) FILTER (WHERE NOT is_ref) - avg(p) FILTER (WHERE is_ref)) > 0.1 END AS drift_detected,
       CASE WHEN count(*) FILTER (WHERE NOT is_ref) >= 10 THEN 'drift monitoring active' ELSE 'not enough predictions' END AS message FROM SH""")
def drift_gate(spark, d):
    return monitor.drift_gate(*_sides(spark, d), "p", 0.1)


@query("drift_from_files", f"""WITH {_VERDICT} SELECT "column", test, drift_detected FROM U""")
def drift_from_files(spark, d):
    """Both sides as CSV files, read back and compared."""
    paths = [files.write_csv(side.select(*COLUMNS), scratch_dir(spark, "drift-csv")) for side in _sides(spark, d)]
    features, _ = drift.report_files(spark, *paths, test=TESTS)
    return features.select("column", "test", "drift_detected")


@query("drift_log", f"""WITH {_VERDICT}
SELECT 'compared' AS status, TIMESTAMP '2024-02-01 12:00:00' AS timestamp, bool_or(drift_detected) AS drift_detected, count(*) AS n_features_analyzed,
       count(*) FILTER (WHERE drift_detected) AS n_features_drifted FROM U
UNION ALL SELECT 'no reference data', TIMESTAMP '2024-02-01 12:00:00', false, 0, 0""")
def drift_log(spark, d):
    """Two checks leave a row each in the drift table: one of two folders, one whose reference is missing."""
    paths = [files.write_csv(side.select(*COLUMNS), scratch_dir(spark, "drift-csv")) for side in _sides(spark, d)]
    checks = [drift.report_files(spark, *paths, test=TESTS), drift.report_files(spark, f"{paths[0]}-missing", paths[1])]
    kept = None
    target = scratch_dir(spark, "drift-log")
    for _, outcome in checks:
        logs.append(logs.drift_row(outcome, "2024-02-01 12:00:00"), target)
        status = outcome.select("status", "n_features_analyzed")
        kept = status if kept is None else kept.unionByName(status)
    back = logs.read(spark, target, logs.DRIFT_LOG)
    return rounded(back.join(kept, "n_features_analyzed").select("status", "timestamp", "drift_detected", "n_features_analyzed", "n_features_drifted"))


STATS = f"""count(*) AS total_predictions, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high, count(*) FILTER (WHERE risk_level = 'LOW') AS n_low,
{r6('avg(probability_at_risk)', 'avg_probability_at_risk')}, max(timestamp) AS latest_prediction"""


@query("prediction_stats", f"WITH {LOG} SELECT {STATS} FROM EV")
def prediction_stats(spark, d):
    return rounded(monitor.stats(star.score_log(spark, d)).drop("risk_distribution"))


def indexed_log(spark, d):
    """The log in four appends that overlap in time."""
    rows = star.score_log(spark, d)
    log = IndexedLog(spark, scratch_dir(spark, "indexed-log"), rows.schema)
    for part in range(4):
        log.append(rows.where(F.col("id") % 4 == part))
    return log


@query("prediction_stats_last_1000", f"WITH {LOG}, L AS (SELECT * FROM EV ORDER BY timestamp DESC, id DESC LIMIT 1000) SELECT {STATS} FROM L")
def prediction_stats_last_1000(spark, d):
    newest = indexed_log(spark, d).latest(1000, F.desc("id"))
    return rounded(monitor.stats(newest).drop("risk_distribution"))


@query("log_latest_1000", f"""WITH {LOG} SELECT id, timestamp, prediction, risk_level, {r6('probability_at_risk', 'probability_at_risk')}, model_type
FROM EV ORDER BY timestamp DESC, id DESC LIMIT 1000""")
def log_latest_1000(spark, d):
    """The log comes in four appends and is compacted; only the newest days are opened."""
    log = indexed_log(spark, d)
    log.compact(1)
    rows = log.latest(1000, F.desc("id"))
    return rounded(rows.select("id", "timestamp", "prediction", "risk_level", "probability_at_risk", "model_type"))


@query("risk_distribution", f"WITH {LOG} SELECT risk_level, count(*) AS n FROM EV GROUP BY risk_level")
def risk_distribution(spark, d):
    return monitor.risk_distribution(star.score_log(spark, d))


@query("risk_distribution_any_level", f"""WITH {LOG}
SELECT model_type || '-' || risk_level AS risk_level, count(*) AS n FROM EV GROUP BY 1""")
def risk_distribution_any_level(spark, d):
    """The distribution inside the statistics, for levels that are not HIGH and LOW."""
    log = star.score_log(spark, d).withColumn("risk_level", F.concat_ws("-", "model_type", "risk_level"))
    return monitor.stats(log).select(F.inline("risk_distribution"))


@query("latest_metrics", f"WITH {LOG} SELECT id, timestamp, risk_level, {r6('probability_at_risk', 'probability_at_risk')} FROM EV ORDER BY timestamp DESC, id DESC LIMIT 1")
def latest_metrics(spark, d):
    log = star.score_log(spark, d).select("id", "timestamp", "risk_level", "probability_at_risk")
    return rounded(monitor.latest_record(log, tie="id"))


@query("metrics_view", f"""WITH {LOG}, {LABELS}, M AS (SELECT {CELLS}, count(*) AS n_test_samples FROM LB), X AS ({SHORT}), K AS (SELECT {MEASURES} FROM X)
SELECT 'fixed rule' AS model_type, (SELECT f1_score FROM K) AS f1_score, (SELECT n_test_samples FROM M) AS n_test_samples,
       (SELECT true_positives FROM M) AS true_positives, count(*) AS total_predictions, max(timestamp) AS latest_prediction FROM EV""")
def metrics_view(spark, d):
    done = evaluate.evaluation(star.labelled_scores(spark, d), "y_true", "y_pred", "y_proba", "fixed rule")
    report = evaluate.matrix_array(done).select(
        F.struct("accuracy", "precision", "recall", "f1_score", "auc_roc").alias("metrics"),
        F.struct("matrix", "true_negatives", "false_positives", "false_negatives", "true_positives").alias("confusion_matrix"),
        "model_type", "n_test_samples", F.lit(None).cast("array<struct<feature:string,importance:double>>").alias("feature_importance"),
    )
    out = monitor.metrics_view(report, star.score_log(spark, d))
    return rounded(out.select(
        "model_type", "metrics.f1_score", "n_test_samples", "confusion_matrix.true_positives",
        "prediction_stats.total_predictions", "prediction_stats.latest_prediction",
    ))


@query("monitoring_summary", f"""WITH {LOG}, {LABELS}, M AS (SELECT {CELLS} FROM LB), X AS ({SHORT}), K AS (SELECT {MEASURES} FROM X)
SELECT 'active' AS status, count(*) AS total_predictions, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high,
       count(*) FILTER (WHERE risk_level = 'LOW') AS n_low, round(avg(probability_at_risk), 4) + 0::DOUBLE AS avg_risk_probability,
       max(timestamp) AS latest_prediction, (SELECT accuracy FROM K) AS accuracy, (SELECT f1_score FROM K) AS f1_score FROM EV""")
def monitoring_summary(spark, d):
    metrics = evaluate.binary_metrics(star.labelled_scores(spark, d), "y_true", "y_pred")
    logged = logs.metrics_row(metrics, "fixed rule", "2024-01-31 00:00:00")
    out = monitor.summary(star.score_log(spark, d), logged, metrics)
    return rounded(out.select(
        "status", "total_predictions", "n_high", "n_low", "avg_risk_probability", "latest_prediction",
        "latest_model_metrics.accuracy", "evaluation_metrics.f1_score",
    ))
