"""Scoring by the fixed rule, and the logs and files around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.catalog.inputs import LOG, PANEL, names, wide
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import score
from cohortlens.session import materialize, scratch_dir
from cohortlens.sources import files, logs, star

RISK = "((10.0::DOUBLE - coalesce(INDE_2001, 0)) * 0.4::DOUBLE + (10.0::DOUBLE - coalesce(IAA_2001, 0)) * 0.3::DOUBLE)"
SCORED = f"""{wide(('INDE', 'IAA', 'FASE'), (2001,))},
F AS (SELECT *, {RISK} AS risk, CAST(CASE WHEN {RISK} > 3.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
      CASE WHEN {RISK} > 3.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM W)"""


def scored(spark, d):
    return score.linear_risk(star.wide(spark, d, ("INDE", "IAA", "FASE"), (2001,)), 2001)


@query("score_fixed_linear", f"WITH {SCORED} SELECT cust_id, {r6('risk', 'risk')}, prediction, risk_level FROM F")
def score_fixed_linear(spark, d):
    return rounded(scored(spark, d).select(star.KEY, "risk", "prediction", "risk_level"))


@query("batch_score_summary", f"""WITH {SCORED}
SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high, count(*) FILTER (WHERE risk_level = 'LOW') AS n_low FROM F""")
def batch_score_summary(spark, d):
    return score.batch_summary(scored(spark, d))


@query("join_inputs_scores", f"""WITH {SCORED}
SELECT c_custkey AS cust_id, c_mktsegment, prediction, risk_level FROM customer LEFT JOIN F ON cust_id = c_custkey""")
def join_inputs_scores(spark, d):
    inputs = star.table(spark, d, "customer").select(F.col("c_custkey").alias(star.KEY), "c_mktsegment")
    return score.attach(inputs, scored(spark, d).select(star.KEY, "prediction", "risk_level"), star.KEY)


_JSON = """'{' || concat_ws(',', '"cust_id":' || CAST(cust_id AS VARCHAR), CASE WHEN FASE_2001 IS NOT NULL THEN '"FASE_2001":' || CAST(FASE_2001 AS VARCHAR) END) || '}'"""


@query("log_prediction_rows", f"""WITH {SCORED}
SELECT TIMESTAMP '2024-02-01 12:00:00' AS timestamp, {_JSON} AS input_data, prediction, risk_level,
       CAST(NULL AS DOUBLE) AS probability_at_risk, 'fixed rule' AS model_type FROM F""")
def log_prediction_rows(spark, d):
    rows = scored(spark, d).withColumn("model_type", F.lit("fixed rule"))
    return rounded(logs.prediction_rows(rows, [star.KEY, "FASE_2001"], "2024-02-01 12:00:00"))


@query("log_append_read", f"""WITH {LOG}
SELECT timestamp, input_data, prediction, risk_level, {r6('probability_at_risk', 'probability_at_risk')}, model_type FROM EV""")
def log_append_read(spark, d):
    """Two appends to a JSON log (one per half of the month), read back."""
    rows = star.score_log(spark, d).drop("id", "user_id")
    path = scratch_dir(spark, "log")
    half = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")
    logs.append(rows.where(half), path)
    logs.append(rows.where(~half), path)
    return rounded(logs.read(spark, path))


@query("log_read", f"""WITH {LOG} SELECT risk_level, count(*) AS n, {r6('avg(probability_at_risk)', 'avg_probability_at_risk')},
max(timestamp) AS latest FROM EV GROUP BY risk_level""")
def log_read(spark, d):
    rows = star.score_log(spark, d).drop("id", "user_id")
    path = scratch_dir(spark, "log")
    logs.append(rows, path)
    return rounded(logs.read(spark, path).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability_at_risk").alias("avg_probability_at_risk"), F.max("timestamp").alias("latest")
    ))


@query("metrics_log", """WITH G AS (SELECT quality AS y, CASE WHEN n_chars / (n_chars + 3000.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS p
FROM labels JOIN documents USING (doc_id))
SELECT TIMESTAMP '2024-02-01 12:00:00' AS timestamp, 'fixed rule' AS model_type,
       """ + r6("count(*) FILTER (WHERE y = p) / count(*)", "accuracy") + " FROM G")
def metrics_log(spark, d):
    from cohortlens.operators import evaluate

    metrics = evaluate.binary_metrics(star.labelled_scores(spark, d), "y_true", "y_pred")
    path = scratch_dir(spark, "metrics-log")
    logs.append(logs.metrics_row(metrics, "fixed rule", "2024-02-01 12:00:00"), path)
    return rounded(logs.read(spark, path, logs.METRICS_LOG).select("timestamp", "model_type", "accuracy"))


_DOUBLES = names(C.SCORE_INDICATORS)
_TEXTS = names((C.ORDINAL, C.GROUP))
_WHOLE = [c for c in names(star.YEARLY) if c not in (*_DOUBLES, *_TEXTS)]


@query("src_csv_roundtrip", f"""WITH {wide()}
SELECT cust_id, {', '.join(r6(c, c) for c in _DOUBLES)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)}, {', '.join(_TEXTS)} FROM W""")
def src_csv_roundtrip(spark, d):
    """The whole panel as CSV, read back with types found in the texts."""
    path = files.write_csv(star.wide(spark, d), scratch_dir(spark, "csv"))
    return rounded(files.read_csv(spark, path))


@query("src_csv_discover", f"""WITH {PANEL}
SELECT CAST(year AS BIGINT) AS year, count(*) AS n, count(INDE) AS n_inde, {r6('sum(INDE)', 'sum_inde')}, count(DISTINCT year) AS n_folders FROM P GROUP BY year""")
def src_csv_discover(spark, d):
    """The panel as CSV in a folder per year below other folders; everything below the top is found, whatever its header's order."""
    top = scratch_dir(spark, "csv-tree")
    rows = star.panel(spark, d, ("INDE", "FASE")).withColumn("half", F.when(F.col("year") < 1998, "old/er").otherwise("new"))
    rows = materialize(rows, "csv-rows")
    for half, order in (("old/er", ["year", "INDE", "FASE"]), ("new", ["FASE", "INDE", "year"])):
        part = rows.where(F.col("half") == half).withColumn("folder", F.col("year")).select("folder", *order)
        part.write.partitionBy("folder").option("header", True).csv(f"{top}/{half}")
    found = files.discover_csv(spark, top)
    folder = F.regexp_extract("source_file", "folder=([0-9]+)", 1)
    return rounded(found.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("INDE").alias("n_inde"), F.sum("INDE").alias("sum_inde"), F.count_distinct(folder).alias("n_folders")))


@query("batch_score_file", f"""WITH {SCORED}
SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high, count(*) FILTER (WHERE risk_level = 'LOW') AS n_low FROM F""")
def batch_score_file(spark, d):
    """CSV in, fixed rule, CSV out, counts of the written file."""
    source = files.write_csv(star.wide(spark, d, ("INDE", "IAA"), (2001,)), scratch_dir(spark, "batch-in"))
    rows = score.linear_risk(files.read_csv(spark, source), 2001)
    result = files.write_csv(rows, scratch_dir(spark, "batch-out"))
    return score.batch_summary(files.read_csv(spark, result, schema=rows.schema, sep=","))
