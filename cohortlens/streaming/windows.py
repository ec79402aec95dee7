"""Prediction statistics over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WATERMARK = "1 hour"


def _measures():
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("probability_at_risk").alias("avg_probability"),
        F.count_if(F.col("risk_level") == "HIGH").alias("n_high"),
    ]


def windowed_stats(log: DataFrame, width: str, slide: str | None = None, by: list[str] = (), watermark: str = WATERMARK) -> DataFrame:
    """Tumbling (or sliding) counts and means per window; works on a stream and on a table."""
    span = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    grouped = log.withWatermark("timestamp", watermark).groupBy(span, *by).agg(*_measures())
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "avg_probability", "n_high"
    )


def session_parts(log: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """Parts of sessions (by, _first, _last, _n, _total, _high): one row per key and bucket of the gap's width.

    Records in one bucket are always one session, so they combine before the shuffle, however busy the key is.
    """
    at = F.col("timestamp").cast("timestamp")
    bucket = F.floor(F.unix_micros(at) / (gap_seconds * 1_000_000))
    return log.groupBy(*by, bucket.alias("_bucket")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.sum("probability_at_risk").alias("_total"), F.count_if(F.col("risk_level") == "HIGH").alias("_high"),
    ).drop("_bucket")


def join_sessions(parts: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """Parts joined to whole sessions, in the same columns: those with no more than the gap between them belong together.

    They become short sessions inside (key, day), which spreads a busy key over its days; then only those sessions
    are chained across days.
    """
    gap = gap_seconds * 1_000_000

    def chained(df, part, first, last):
        """Number the runs of rows whose distance to the latest end before them is at most the gap."""
        before = Window.partitionBy(*part).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
        opens = F.unix_micros(first) - F.unix_micros(F.max(last).over(before)) <= gap
        marked = df.withColumn("_opens", F.when(opens, 0).otherwise(1))
        # of rows with equal times, the one that opens a session comes first
        upto = Window.partitionBy(*part).orderBy(first, last, F.desc("_opens")).rowsBetween(Window.unboundedPreceding, 0)
        return marked.withColumn("_session", F.sum("_opens").over(upto))

    def folded(df, part):
        return df.groupBy(*part, "_session").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(c).alias(c) for c in ("_n", "_total", "_high")],
        ).drop("_session")

    rows = parts.withColumn("_day", F.date_trunc("day", "_first"))
    days = folded(chained(rows, [*by, "_day"], "_first", "_last"), [*by, "_day"]).drop("_day")
    return folded(chained(days, by, "_first", "_last"), by)


def session_rows(joined: DataFrame, by: list[str], gap_seconds: int = 1800, keep: list[str] = ()) -> DataFrame:
    """Sessions in the form of `sessions`."""
    return joined.select(
        *by, F.col("_first").alias("session_start"), F.timestamp_micros(F.unix_micros("_last") + gap_seconds * 1_000_000).alias("session_end"),
        F.col("_n").alias("n"), (F.col("_total") / F.col("_n")).alias("avg_probability"), F.col("_high").alias("n_high"), *keep,
    )


def sessions_table(log: DataFrame, by: list[str], gap_seconds: int = 1800) -> DataFrame:
    """The sessions of a whole table, safe for keys with very many records."""
    return session_rows(join_sessions(session_parts(log, by, gap_seconds), by, gap_seconds), by, gap_seconds)


def sessions(log: DataFrame, by: list[str], gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """One row per session of a stream: a session closes when more than `gap` passes without a record."""
    grouped = log.withWatermark("timestamp", watermark).groupBy(F.session_window("timestamp", gap).alias("s"), *by)
    return grouped.agg(*_measures()).select(
        *by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "avg_probability", "n_high"
    )


def drift_windows(log: DataFrame, reference_mean: float, threshold: float, width: str, minimum: int = 10,
                  watermark: str = WATERMARK) -> DataFrame:
    """Mean of each window against a fixed reference mean; no verdict for windows with fewer than `minimum` rows."""
    grouped = log.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", width)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability_at_risk").alias("current_mean")
    )
    diff = F.abs(F.col("current_mean") - F.lit(float(reference_mean)))
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "current_mean",
        diff.alias("mean_difference"), F.when(F.col("n") >= minimum, diff > threshold).alias("drift_detected"),
    )
