"""Start streams that read folders and write folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohortlens.operators import contract
from cohortlens.plans.scoring import Scorer
from cohortlens.sources import logs
from cohortlens.streaming import store, windows


def read_stream(spark: SparkSession, path: str, schema: str | StructType, form: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """A folder as a stream; a single file is read through its folder."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def drain(stream: DataFrame, root: str, form: str = "parquet") -> DataFrame:
    """Process what is there, then stop; the result is the table that the append sink wrote below `root`.

    Aggregates appear once the watermark has closed their window. Offsets and state live in `root`, so a later call
    with the same folder takes only what has come since and keeps open windows.
    """
    query = (
        stream.writeStream.outputMode("append").format(form).option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/rows").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).format(form).load(f"{root}/rows")


def upsert(stream: DataFrame, root: str, keys: list[str], time: str = "window_start", files: int = 1) -> StreamingQuery:
    """Start a query in update mode that keeps one row per key in a table by days below `root`, and stops when all is read.

    A batch brings the windows that changed; only their days are read and written, so neither the batch nor the state
    grows with the age of the stream: the watermark ends the state of a window, its last row stays in the table.
    A batch that is repeated after a failure counts once (see `store`). `files` bounds the files of a day.
    """
    table = store.DayTable(stream.sparkSession, root, stream.schema, time, files)

    def merge(rows: DataFrame, batch: int) -> None:
        # written once, since the state must not be computed for each of the reads below
        changes = f"{root}/changes"
        rows.write.mode("overwrite").parquet(changes)
        table.upsert(rows.sparkSession.read.schema(stream.schema).parquet(changes), keys, batch)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(merge)
    return writer.trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, root: str, schema: StructType, days: list[str] | None = None) -> DataFrame:
    """The table that `upsert` keeps, or some days of it."""
    return store.DayTable(spark, root, schema, "window_start").read(days)


def drain_upsert(stream: DataFrame, root: str, keys: list[str], time: str = "window_start") -> DataFrame:
    """Process what is there, then stop; the result holds all windows so far, open ones too. A later call goes on."""
    upsert(stream, root, keys, time).awaitTermination()
    return read_upserts(stream.sparkSession, root, stream.schema)


class Arrivals:
    """The rows of a stream as they came, with those too late kept apart.

    A row is late if what it belongs to (`closes`, its time if not said) had ended by the watermark of the batch before: the
    latest time seen until then less `delay`. Each batch writes its rows once, to `arrivals/_batch=N/_late=true|false`, and the
    counts and the latest time come from metrics observed while it writes. Manifests hold the watermark and the counts.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, delay: str = windows.WATERMARK, time: str = "timestamp", closes: Column | None = None):
        self.spark, self.root, self.schema, self.delay, self.time = spark, root, schema, delay, time
        self.closes = F.col(time) if closes is None else closes
        self.manifests = store.Manifests(spark, root)

    def take(self, rows: DataFrame, batch: int) -> dict:
        """Write a batch; returns what its manifest has to say. The caller commits it."""
        before = self.manifests.last(batch)
        held = before.get("watermark_micros")
        late = F.lit(False) if held is None else F.coalesce(F.unix_micros(self.closes) <= held, F.lit(False))
        seen = Observation("arrivals")
        marked = rows.withColumn("_late", late).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if("_late").alias("n_late"),
            F.max(F.unix_micros(F.col(self.time) - F.expr(f"INTERVAL {self.delay}"))).alias("watermark"))
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{self.root}/arrivals/_batch={batch}")
        found = seen.get
        counts = {"batch": batch, "n": found["n"], "n_late": found["n_late"]}
        marks = [m for m in (held, found["watermark"]) if m is not None]
        return {"watermark_micros": max(marks, default=None), "counts": [*before.get("counts", []), counts][-self.KEPT:]}

    #: Batches whose counts the manifest keeps.
    KEPT = 1000

    def of_batch(self, batch: int) -> DataFrame:
        """The rows of one batch that were on time."""
        return self._read(f"{self.root}/arrivals/_batch={batch}").where("NOT _late").drop("_late")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("_late", "boolean")).option("basePath", path).parquet(path)

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows on time, late rows, counts by batch)."""
        counts = self.manifests.last().get("counts", [])
        table = self.spark.createDataFrame([(c["batch"], c["n"], c["n_late"]) for c in counts], "batch bigint, n bigint, n_late bigint")
        path = f"{self.root}/arrivals"
        schema = StructType([*self.schema.fields]).add("_batch", "long").add("_late", "boolean")
        whole = self.spark.read.schema(schema).parquet(path) if counts else self.spark.createDataFrame([], schema)
        # a batch counts when its manifest is there
        whole = whole.where(F.col("_batch") <= max((c["batch"] for c in counts), default=-1)).drop("_batch")
        return whole.where("NOT _late").drop("_late"), whole.where("_late").drop("_late"), table


def _drain_batches(stream: DataFrame, root: str, step) -> None:
    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_late(stream: DataFrame, root: str, delay: str = windows.WATERMARK, time: str = "timestamp", closes: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Process what is there, then stop: (rows on time, late rows, counts by batch), see `Arrivals`."""
    arrivals = Arrivals(stream.sparkSession, root, stream.schema, delay, time, closes)

    def step(rows: DataFrame, batch: int) -> None:
        arrivals.manifests.commit(batch, arrivals.take(rows, batch))
        arrivals.manifests.forget()

    _drain_batches(stream, root, step)
    return arrivals.read()


def drain_sessions(log: DataFrame, root: str, by: list[str], gap_seconds: int = 1800, delay: str = windows.WATERMARK) -> DataFrame:
    """Process what is there, then stop: all sessions of a log stream so far, with `open` for those that may still grow.

    A batch joins its rows to the open sessions of the batch before and writes both kinds: closed sessions are appended and
    never read again, open ones replace the open ones before. What a batch reads is therefore bounded by its rows and
    by the sessions that the watermark has not passed. Rows whose session would have ended by then are late and kept apart.
    """
    spark = log.sparkSession
    ends = F.timestamp_micros(F.unix_micros("timestamp") + gap_seconds * 1_000_000)
    arrivals = Arrivals(spark, root, log.schema, delay, "timestamp", ends)
    manifests = arrivals.manifests
    state = windows.session_parts(spark.createDataFrame([], log.schema), by, gap_seconds).schema

    def sessions_of(batch: int, kind: str) -> DataFrame:
        path = f"{root}/sessions/_batch={batch}"
        return spark.read.schema(StructType([*state.fields]).add("_open", "boolean")).parquet(path).where(kind).drop("_open")

    def step(rows: DataFrame, batch: int) -> None:
        before = manifests.last(batch)
        said = arrivals.take(rows, batch)
        parts = windows.session_parts(arrivals.of_batch(batch), by, gap_seconds)
        if "sessions" in before:
            parts = parts.unionByName(sessions_of(before["sessions"], "_open"))
        joined = windows.join_sessions(parts, by, gap_seconds)
        mark = said["watermark_micros"]
        still = F.lit(True) if mark is None else F.unix_micros("_last") + gap_seconds * 1_000_000 > mark
        joined.withColumn("_open", still).write.mode("overwrite").partitionBy("_open").parquet(f"{root}/sessions/_batch={batch}")
        manifests.commit(batch, {**said, "sessions": batch})
        manifests.drop(f"arrivals/_batch={batch}/_late=false")
        for number in [n for n in manifests.numbers() if n < batch][:-1]:
            manifests.drop(f"sessions/_batch={number}/_open=true")
        manifests.forget()

    _drain_batches(log, root, step)
    last = manifests.last().get("sessions")
    if last is None:
        return windows.session_rows(spark.createDataFrame([], state), by, gap_seconds).withColumn("open", F.lit(False))
    schema = StructType([*state.fields]).add("_batch", "long").add("_open", "boolean")
    found = spark.read.schema(schema).parquet(f"{root}/sessions").where((F.col("_batch") == last) | (~F.col("_open") & (F.col("_batch") < last)))
    return windows.session_rows(found, by, gap_seconds, [F.col("_open").alias("open")])


CORRUPT = "_corrupt_record"
#: Where a line of a record stream goes.
WAYS = ("scored", "rejected", "unreadable")


def read_records(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines of a folder as a stream; a line that is no record of the schema is in the column `_corrupt_record`."""
    whole = StructType([f for f in schema.fields if f.name != CORRUPT]).add(CORRUPT, "string")
    reader = spark.readStream.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def route(stream: DataFrame, rules: dict[str, tuple[float, float]], predict: Callable[[DataFrame], DataFrame], keep: list[str],
          timestamp: str | Column | None = None) -> DataFrame:
    """One row per line with its way: a log row (`scored`), a record out of bounds with its `violations`, or an unreadable `line`.

    `predict` adds prediction columns and keeps the others, as `score.linear_risk` or a scorer does. Only scored rows carry a
    prediction. Stateless, so any split into batches gives the same rows; the stream is read once.
    """
    checked = contract.check(stream, rules)
    way = F.when(F.col(CORRUPT).isNotNull(), WAYS[2]).when(F.size("violations") > 0, WAYS[1]).otherwise(WAYS[0])
    rows = logs.prediction_rows(predict(checked.withColumn("way", way)), keep, timestamp, ["violations", CORRUPT, "way"])
    scored = F.col("way") == WAYS[0]
    return rows.select(
        "timestamp", F.when(F.col("way") != WAYS[2], F.col("input_data")).alias("input_data"),
        *[F.when(scored, F.col(c)).alias(c) for c in ("prediction", "risk_level", "probability_at_risk", "model_type")],
        F.when(F.col("way") == WAYS[1], F.col("violations")).alias("violations"), F.col(CORRUPT).alias("line"), "way")


def drain_ways(routed: DataFrame, root: str) -> dict[str, DataFrame]:
    """Process what is there, then stop: the three tables by way, each in a folder of its own below `root`.

    One query writes them, so every line is in exactly one of them, once, also after a failure.
    """
    query = (
        routed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        .option("path", f"{root}/rows").partitionBy("way").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = routed.sparkSession.read.schema(routed.schema).parquet(f"{root}/rows")
    columns = {
        "scored": StructType.fromDDL(logs.PREDICTION_LOG).names, "rejected": ["timestamp", "input_data", "violations"], "unreadable": ["timestamp", "line"],
    }
    return {way: rows.where(F.col("way") == way).select(columns[way]) for way in WAYS}


def score_stream(stream: DataFrame, scorer: Scorer, keep: list[str], timestamp: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(prediction log rows of the valid records, rejected records with their violations) of a stream.

    Both are stateless, so any split into batches gives the same rows; write each to its own sink. `route` reads the stream once
    for both and has a third way for lines that are no records.
    """
    rules = contract.panel_rules(stream.columns, scorer.preparation.spec.years)
    valid, rejected = contract.split(stream, rules)
    return logs.prediction_rows(scorer.predict(valid, keep, timestamp), keep), rejected


def start_append(rows: DataFrame, path: str, checkpoint: str, interval: str = "1 minute"):
    """Keep appending log rows to a day-partitioned folder; returns the running query."""
    return (
        rows.withColumn("log_date", F.to_date("timestamp")).writeStream.outputMode("append").format("parquet")
        .partitionBy("log_date").option("checkpointLocation", checkpoint).option("path", path)
        .trigger(processingTime=interval).start()
    )
