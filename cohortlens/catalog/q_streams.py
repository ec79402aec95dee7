"""Streams over the event and panel tables, drained once and compared with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog.inputs import LOG
from cohortlens.catalog.q_panel import BROKEN, VIOLATIONS, _RECORDS, _records, rules
from cohortlens.catalog.q_score import RISK
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import contract, score
from cohortlens.session import scratch_dir
from cohortlens.sources import logs, star
from cohortlens.streaming import runs, windows

MEASURES = f"count(*) AS n, {r6('avg(probability_at_risk)', 'avg_probability')}, count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high"


def _log_stream(spark, d):
    stream = runs.read_stream(spark, f"{d}/events.parquet", star.SCHEMAS["events"])
    return star.as_score_log(stream)


_INPUT = """'{"cust_id":' || CAST(cust_id AS VARCHAR) || '}'"""


def _halves(spark, d):
    """The events up to the middle of the month, and those after it."""
    events = star.table(spark, d, "events")
    first = F.col("ts") < F.lit("2024-01-16 00:10:00").cast("timestamp_ntz")
    return events.where(first), events.where(~first)


@query("stream_score", f"""WITH {_RECORDS}
SELECT TIMESTAMP '2024-02-01 12:00:00' AS timestamp, {_INPUT} AS input_data,
       CAST(CASE WHEN {RISK} > 3.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction, CASE WHEN {RISK} > 3.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM R WHERE NOT ({BROKEN})""")
def stream_score(spark, d):
    """Records arrive as files; valid ones are scored by the fixed rule and appended to the log."""
    records = _records(spark, d)
    source = scratch_dir(spark, "records")
    records.write.parquet(source)
    stream = runs.read_stream(spark, source, records.schema, files_per_trigger=4)
    valid, _ = contract.split(stream, rules(stream))
    rows = logs.prediction_rows(score.linear_risk(valid, star.LATEST), [star.KEY], "2024-02-01 12:00:00")
    return rounded(runs.drain(rows.drop("probability_at_risk", "model_type"), scratch_dir(spark, "stream-score")))


@query("stream_quarantine", f"WITH {_RECORDS}\nSELECT cust_id, {VIOLATIONS} AS violations FROM R WHERE {BROKEN}")
def stream_quarantine(spark, d):
    """The records of the same stream that are out of bounds have a sink of their own."""
    records = _records(spark, d)
    source = scratch_dir(spark, "records")
    records.write.parquet(source)
    stream = runs.read_stream(spark, source, records.schema, files_per_trigger=4)
    _, rejected = contract.split(stream, rules(stream))
    rows = rejected.select(star.KEY, F.array_join(F.array_sort("violations"), ",").alias("violations"))
    return runs.drain(rows, scratch_dir(spark, "stream-quarantine"))


@query("stream_corrupt", f"""WITH {_RECORDS}
SELECT cust_id, CASE WHEN cust_id % 11 = 5 THEN 'unreadable' WHEN {BROKEN} THEN 'rejected' ELSE 'scored' END AS way,
       CASE WHEN cust_id % 11 <> 5 AND NOT ({BROKEN}) THEN CASE WHEN {RISK} > 3.5 THEN 'HIGH' ELSE 'LOW' END END AS risk_level,
       CASE WHEN cust_id % 11 <> 5 AND ({BROKEN}) THEN {VIOLATIONS} END AS violations FROM R""")
def stream_corrupt(spark, d):
    """One stream of JSON lines, some of them cut short, and three sinks: log rows, rejected records, unreadable lines."""
    records = _records(spark, d)
    line = F.to_json(F.struct("*"))
    # a record may hold nothing but its key, which stays whole
    key = F.length(F.concat(F.lit(f'{{"{star.KEY}":'), F.col(star.KEY).cast("string")))
    cut = F.when(F.col(star.KEY) % 11 == 5, F.substring(line, F.lit(1), F.greatest(F.length(line) - 7, key))).otherwise(line)
    source = scratch_dir(spark, "lines")
    records.select(cut.alias("value")).write.text(source)
    stream = runs.read_records(spark, source, records.schema, files_per_trigger=4)
    ways = runs.drain_ways(runs.route(stream, rules(stream), lambda df: score.linear_risk(df, star.LATEST), [star.KEY], "2024-02-01 12:00:00"), scratch_dir(spark, "ways"))

    def rows(way, text, risk_level="CAST(NULL AS string)", violations="CAST(NULL AS string)"):
        key = F.regexp_extract(text, f'"{star.KEY}":(-?[0-9]+)', 1).try_cast("bigint")
        return ways[way].select(key.alias(star.KEY), F.lit(way).alias("way"), F.expr(risk_level).alias("risk_level"), F.expr(violations).alias("violations"))

    found = rows("scored", "input_data", risk_level="risk_level").unionByName(rows("rejected", "input_data", violations="array_join(array_sort(violations), ',')"))
    return found.unionByName(rows("unreadable", "line"))


@query("stream_stats_tumbling", f"""WITH {LOG}
SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, time_bucket(INTERVAL 1 DAY, timestamp) + INTERVAL 1 DAY AS window_end, {MEASURES}
FROM EV GROUP BY 1, 2""")
def stream_stats_tumbling(spark, d):
    return rounded(runs.drain_upsert(windows.windowed_stats(_log_stream(spark, d), "1 day"), scratch_dir(spark, "tumbling"), ["window_start"]))


@query("stream_stats_by_model", f"""WITH {LOG}
SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, time_bucket(INTERVAL 1 DAY, timestamp) + INTERVAL 1 DAY AS window_end, model_type, {MEASURES}
FROM EV GROUP BY 1, 2, 3""")
def stream_stats_by_model(spark, d):
    return rounded(runs.drain_upsert(windows.windowed_stats(_log_stream(spark, d), "1 day", by=["model_type"]), scratch_dir(spark, "by-model"), ["window_start", "model_type"]))


_SLIDES = f"""{LOG}, X AS (
  SELECT time_bucket(INTERVAL 6 HOUR, timestamp) - k * INTERVAL 6 HOUR AS window_start, * FROM EV, range(0, 4) t(k))"""


@query("stream_stats_sliding", f"""WITH {_SLIDES}
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, {MEASURES}
FROM X GROUP BY 1, 2""")
def stream_stats_sliding(spark, d):
    return rounded(runs.drain_upsert(windows.windowed_stats(_log_stream(spark, d), "1 day", "6 hours"), scratch_dir(spark, "sliding"), ["window_start"]))


@query("stats_sliding_batch", f"WITH {_SLIDES} SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, {MEASURES} FROM X GROUP BY 1, 2")
def stats_sliding_batch(spark, d):
    return rounded(windows.windowed_stats(star.score_log(spark, d), "1 day", "6 hours"))


@query("stream_drift_windows", f"""WITH {LOG}, M AS (SELECT avg(probability_at_risk) AS m FROM EV WHERE timestamp < TIMESTAMP '2024-01-16'),
G AS (SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS n, avg(probability_at_risk) AS a FROM EV GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, n, {r6('a', 'current_mean')}, {r6('abs(a - m)', 'mean_difference')},
       CASE WHEN n >= 10 THEN abs(a - m) > 0.02 END AS drift_detected FROM G, M""")
def stream_drift_windows(spark, d):
    log = star.score_log(spark, d)
    before = log.where(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"))
    mean = before.agg(F.avg("probability_at_risk")).head()[0]
    return rounded(runs.drain_upsert(windows.drift_windows(_log_stream(spark, d), mean, 0.02, "1 day"), scratch_dir(spark, "drift-windows"), ["window_start"]))


_SESSIONS = f"""{LOG}, A AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
  FROM EV WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)),
B AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY timestamp, id) AS s FROM A),
G AS (SELECT user_id, s, min(timestamp) AS session_start, max(timestamp) + INTERVAL 30 MINUTE AS session_end, {MEASURES} FROM B GROUP BY 1, 2)"""


@query("stream_sessions", f"WITH {_SESSIONS} SELECT * EXCLUDE (s) FROM G")
def stream_sessions(spark, d):
    """Two drains of a folder that grows in between; sessions that are open after the first one go on in the second."""
    source, out = scratch_dir(spark, "session-events"), scratch_dir(spark, "sessions")
    for part in _halves(spark, d):
        part.write.mode("append").parquet(source)
        found = runs.drain_sessions(star.as_score_log(runs.read_stream(spark, source, star.SCHEMAS["events"])), out, ["user_id"])
    return rounded(found.drop("open"))


@query("sessions_batch", f"WITH {_SESSIONS} SELECT * EXCLUDE (s) FROM G")
def sessions_batch(spark, d):
    return rounded(windows.sessions_table(star.score_log(spark, d), ["user_id"]))


@query("stream_upsert", f"""WITH {LOG}
SELECT time_bucket(INTERVAL 6 HOUR, timestamp) AS window_start, time_bucket(INTERVAL 6 HOUR, timestamp) + INTERVAL 6 HOUR AS window_end, model_type, {MEASURES}
FROM EV GROUP BY 1, 2, 3""")
def stream_upsert(spark, d):
    """Two drains of a folder that grows in between, inside a window; each batch replaces only the days it touches."""
    source, out = scratch_dir(spark, "upsert-events"), scratch_dir(spark, "upsert")
    for part in _halves(spark, d):
        part.write.mode("append").parquet(source)
        log = star.as_score_log(runs.read_stream(spark, source, star.SCHEMAS["events"]))
        found = runs.drain_upsert(windows.windowed_stats(log, "6 hours", by=["model_type"]), out, ["window_start", "model_type"])
    return rounded(found)


@query("stream_late", f"""WITH {LOG}, M AS (SELECT max(timestamp) - INTERVAL 1 HOUR AS mark FROM EV WHERE id % 10 <> 0),
A AS (SELECT *, id % 10 = 0 AND time_bucket(INTERVAL 6 HOUR, timestamp) + INTERVAL 6 HOUR <= mark AS late FROM EV, M)
SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE late) AS n_late, (SELECT count(*) FROM A WHERE late) AS counted_late FROM A GROUP BY 1""")
def stream_late(spark, d):
    """A tenth of the events comes in a second batch; those whose window had ended by then are counted and kept apart."""
    events = star.table(spark, d, "events")
    source, out = scratch_dir(spark, "late-events"), scratch_dir(spark, "late")
    for part in (events.where("event_id % 10 <> 0"), events.where("event_id % 10 = 0")):
        part.write.mode("append").parquet(source)
        log = star.as_score_log(runs.read_stream(spark, source, star.SCHEMAS["events"]))
        on_time, late, counts = runs.drain_late(log, out, closes=F.window("timestamp", "6 hours")["end"])
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    days = both.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))
    return days.withColumn("counted_late", F.lit(counts.agg(F.sum("n_late")).head()[0]).cast("bigint"))
