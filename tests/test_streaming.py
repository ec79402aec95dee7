import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import logs
from cohortlens.streaming import runs, windows
from helpers import NOW

SCHEMA = "id bigint, timestamp timestamp, risk_level string, probability_at_risk double, user string"


@pytest.fixture
def folder(frame, tmp_path):
    """Two files: the second has one row that is far too late."""
    def rows(*items):
        return frame("id bigint, timestamp string, risk_level string, probability_at_risk double, user string", *items).withColumn(
            "timestamp", F.col("timestamp").cast("timestamp"))

    path = str(tmp_path / "in")
    rows((1, "2024-01-01 10:00:00", "HIGH", 0.9, "a"), (2, "2024-01-01 10:10:00", "LOW", 0.1, "a"),
         (3, "2024-01-02 09:00:00", "LOW", 0.3, "b")).coalesce(1).write.mode("append").parquet(path)
    rows((4, "2024-01-01 11:00:00", "HIGH", 0.8, "a"), (5, "2024-01-03 09:00:00", "HIGH", 0.7, "a"),
         (6, "2024-01-04 09:00:00", "LOW", 0.2, "b")).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, per_trigger=None):
    return runs.read_stream(spark, folder, SCHEMA, files_per_trigger=per_trigger)


@pytest.fixture
def out(tmp_path):
    return str(tmp_path / "out")


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def closed(df, end):
    return df.where(F.col(end) <= F.lit("2024-01-04 08:00:00").cast("timestamp"))


def test_tumbling_equals_batch(spark, folder, out):
    got = runs.drain(windows.windowed_stats(stream(spark, folder), "1 day"), out)
    want = closed(windows.windowed_stats(batch(spark, folder), "1 day"), "window_end")
    assert got.count() == 3 and got.exceptAll(want).count() == 0


def test_sliding_equals_batch(spark, folder, out):
    got = runs.drain(windows.windowed_stats(stream(spark, folder), "1 day", "6 hours"), out)
    want = closed(windows.windowed_stats(batch(spark, folder), "1 day", "6 hours"), "window_end")
    assert got.count() == want.count() > 5 and got.exceptAll(want).count() == 0


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark, frame, out, tmp_path):
    """One file per batch, in the order of their times; a late row is judged by the watermark of the batch before."""
    path = str(tmp_path / "in")
    for number, at in enumerate(("2024-01-01 10:00:00", "2024-01-02 09:00:00", "2024-01-03 09:00:00", "2024-01-01 11:00:00", "2024-01-05 09:00:00")):
        row = frame("id bigint, timestamp string, risk_level string, probability_at_risk double, user string", (number, at, "HIGH", 0.9, "a"))
        row.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        for file in set(glob.glob(f"{path}/part-*.parquet")):
            if os.path.getmtime(file) > 1_700_000_100:
                os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    one = {r["window_start"].day: r["n"] for r in runs.drain(windows.windowed_stats(stream(spark, path, 1), "1 day"), out).collect()}
    assert one == {1: 1, 2: 1, 3: 1}


def test_sessions(spark, folder, out):
    got = runs.drain(windows.sessions(stream(spark, folder), ["user"]), out)
    want = closed(windows.sessions(batch(spark, folder), ["user"]), "session_end")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {(r["user"], r["n"]) for r in got.collect()} >= {("a", 2), ("a", 1), ("b", 1)}


def test_drift_windows(spark, folder, out):
    got = {r["window_start"].day: r for r in runs.drain(windows.drift_windows(stream(spark, folder), 0.2, 0.3, "1 day", minimum=2), out).collect()}
    assert got[1]["drift_detected"] is True and got[2]["drift_detected"] is None


def test_single_file_source(spark, folder, out):
    file = sorted(glob.glob(f"{folder}/part-*.parquet"))[0]
    assert runs.drain(stream(spark, file).select("id"), out).count() == 3


def test_sessions_of_a_table_equal_session_windows(spark):
    """One user holds most records, days meet at midnight, and equal times occur."""
    start = F.lit("2024-01-01").cast("timestamp")
    log = spark.range(4000).select(
        F.col("id"), (start + F.make_dt_interval(secs=(F.pmod(F.xxhash64("id"), F.lit(5 * 86400))).cast("decimal(18,6)"))).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "LOW").otherwise("HIGH").alias("risk_level"), (F.col("id") % 100 / 100.0).alias("probability_at_risk"),
        F.when(F.col("id") % 10 < 8, "busy").otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("user"),
    )
    def comparable(df):
        return df.withColumn("avg_probability", F.round("avg_probability", 9))

    for seconds in (120, 1800, 7200):
        got = comparable(windows.sessions_table(log, ["user"], seconds))
        want = comparable(windows.sessions(log, ["user"], f"{seconds} seconds"))
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_stream_scoring_equals_batch_and_keeps_rejected_records(spark, trained, panel, out, tmp_path):
    scorer = trained[1].scorer
    df = panel.where("row_id < 80").withColumn("INDE_2022", F.when(F.col("row_id") % 10 == 0, 11.0).otherwise(5.0))
    path = str(tmp_path / "records")
    df.repartition(3).write.parquet(path)
    scored, rejected = runs.score_stream(runs.read_stream(spark, path, df.schema, files_per_trigger=1), scorer, ["row_id"], NOW)
    got = runs.drain(scored, out)
    bad = runs.drain(rejected.select("row_id", "violations"), f"{out}-rejected").collect()
    assert sorted(r["row_id"] for r in bad) == list(range(0, 80, 10)) and bad[0]["violations"] == ["INDE_2022"]
    want = logs.prediction_rows(scorer.predict(df.where("INDE_2022 <= 10"), ["row_id"], NOW), ["row_id"])
    assert got.count() == 72 and got.exceptAll(want).count() == 0


def one_file_each(spark, frame, path, times):
    """A file per row, read in this order when one file makes a batch."""
    for number, at in enumerate(times, len(glob.glob(f"{path}/part-*.parquet"))):
        row = frame("id bigint, timestamp string, risk_level string, probability_at_risk double, user string", (number, at, "HIGH", 0.5, "a"))
        row.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        for file in set(glob.glob(f"{path}/part-*.parquet")):
            if os.path.getmtime(file) > 1_700_000_500:
                os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))


def test_upserts_hold_open_windows_and_go_on(spark, folder, out):
    make = lambda: windows.windowed_stats(stream(spark, folder), "1 day", by=["user"])
    keys = ["window_start", "user"]
    got = runs.drain_upsert(make(), out, keys)
    want = windows.windowed_stats(batch(spark, folder), "1 day", by=["user"])
    assert got.count() == want.count() == 4 and got.exceptAll(want).count() == 0
    more = batch(spark, folder).where("id = 6").withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 30 MINUTES"))
    more.unionByName(more.withColumn("user", F.lit(None).cast("string"))).coalesce(1).write.mode("append").parquet(folder)
    again, want = runs.drain_upsert(make(), out, keys), windows.windowed_stats(batch(spark, folder), "1 day", by=["user"])
    assert again.count() == want.count() == 5 and again.exceptAll(want).count() == 0


def test_upserts_write_only_the_days_they_touch_and_their_state_ends(spark, frame, out, tmp_path):
    path = str(tmp_path / "in")
    one_file_each(spark, frame, path, [f"2024-01-0{d} 10:00:00" for d in range(1, 9)])
    query = runs.upsert(windows.windowed_stats(stream(spark, path, 1), "1 day"), out, ["window_start"])
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(rows) <= 3 and rows[-1] <= 2  # of eight windows
    kept = {os.path.relpath(p, f"{out}/rows") for p in glob.glob(f"{out}/rows/*/_day=*")}
    assert len(kept) == 8 and len(glob.glob(f"{out}/manifest/*")) == 2
    assert runs.read_upserts(spark, out, windows.windowed_stats(batch(spark, path), "1 day").schema).count() == 8
    one_file_each(spark, frame, path, ["2024-01-08 11:00:00"])
    runs.upsert(windows.windowed_stats(stream(spark, path, 1), "1 day"), out, ["window_start"]).awaitTermination()
    now = {os.path.relpath(p, f"{out}/rows") for p in glob.glob(f"{out}/rows/*/_day=*")}
    assert len(now - kept) == 1 and next(iter(now - kept)).endswith("_day=2024-01-08")


def test_a_batch_that_is_repeated_counts_once(spark, frame, tmp_path):
    from cohortlens.streaming import store

    def changes(*rows):
        return frame("window_start string, n bigint", *rows).withColumn("window_start", F.col("window_start").cast("timestamp"))

    first = changes(("2024-01-01", 1), ("2024-01-02", 2))
    table = store.DayTable(spark, str(tmp_path / "t"), first.schema, "window_start")
    table.upsert(first, ["window_start"], 0)
    for _ in range(3):
        table.upsert(changes(("2024-01-02", 5), ("2024-01-03", 6)), ["window_start"], 1)
    table.upsert(changes(), ["window_start"], 2)
    assert sorted((str(r["window_start"])[:10], r["n"]) for r in table.read().collect()) == [("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-03", 6)]
    assert [r["n"] for r in table.read(["2024-01-02"]).collect()] == [5]


def test_sessions_with_open_ones_over_two_drains(spark, folder, frame, out):
    make = lambda: runs.drain_sessions(stream(spark, folder), out, ["user"], 1800)
    got, want = make(), windows.sessions_table(batch(spark, folder), ["user"], 1800)
    assert got.drop("open").exceptAll(want).count() == 0 and got.count() == want.count()
    assert [(r["user"], r["n"]) for r in got.where("open").collect()] == [("b", 1)]
    more = frame("id bigint, timestamp string, risk_level string, probability_at_risk double, user string",
                 (7, "2024-01-04 09:20:00", "LOW", 0.4, "b"), (8, "2024-01-05 09:00:00", "LOW", 0.4, "c"), (9, "2024-01-01 12:00:00", "LOW", 0.4, "a"))
    more.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    got, want = make(), windows.sessions_table(batch(spark, folder).where("id <> 9"), ["user"], 1800)
    near = lambda df: df.withColumn("avg_probability", F.round("avg_probability", 9))
    assert near(got.drop("open")).exceptAll(near(want)).count() == 0 and got.count() == want.count()
    assert [r["user"] for r in got.where("open").collect()] == ["c"]
    assert len(glob.glob(f"{out}/sessions/*/_open=true")) <= 2


def test_late_rows_are_counted_and_kept_apart(spark, frame, out, tmp_path):
    path = str(tmp_path / "in")
    one_file_each(spark, frame, path, ["2024-01-01 10:00:00", "2024-01-02 09:00:00", "2024-01-01 23:30:00", "2024-01-02 08:00:00", "2024-01-02 07:59:00"])
    on_time, late, counts = runs.drain_late(stream(spark, path, 1), out)
    assert sorted(r["id"] for r in late.collect()) == [2, 3, 4] and on_time.count() == 2
    assert [(r["batch"], r["n"], r["n_late"]) for r in counts.orderBy("batch").collect()] == [(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 1)]
    day = F.window("timestamp", "1 day")["end"]
    assert [r["id"] for r in runs.drain_late(stream(spark, path, 1), f"{out}-day", closes=day)[1].collect()] == [2]


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_lines_go_three_ways(spark, trained, panel, out, tmp_path, per_trigger):
    scorer = trained[1].scorer
    df = panel.where("row_id < 60").withColumn("INDE_2022", F.when(F.col("row_id") % 10 == 0, 11.0).otherwise(5.0))
    path = str(tmp_path / "lines")
    line = F.to_json(F.struct("*"))
    broken = (F.when(F.col("row_id") % 10 == 1, F.substring(line, F.lit(1), F.length(line) - 3)).when(F.col("row_id") % 10 == 2, F.lit("no json"))
              .when(F.col("row_id") % 10 == 3, F.lit('{"row_id": "text"}')).otherwise(line))
    df.repartition(3).select(broken.alias("value")).unionByName(spark.createDataFrame([("",)], "value string")).write.text(path)
    records = runs.read_records(spark, path, df.schema, per_trigger)
    from cohortlens.operators import contract

    routed = runs.route(records, contract.panel_rules(df.columns, scorer.preparation.spec.years), lambda rows: scorer.predict(rows, rows.columns, NOW), ["row_id"])
    ways = runs.drain_ways(routed, out)
    assert {w: t.count() for w, t in ways.items()} == {"scored": 60 - 24, "rejected": 6, "unreadable": 18}
    assert {r["line"] for r in ways["unreadable"].collect()} >= {"no json", '{"row_id": "text"}'}
    assert {tuple(r["violations"]) for r in ways["rejected"].collect()} == {("INDE_2022",)}
    want = logs.prediction_rows(scorer.predict(df.where("row_id % 10 > 3"), ["row_id"], NOW), ["row_id"])
    assert ways["scored"].exceptAll(want).count() == 0


def test_a_drained_stream_goes_on_in_the_same_folder(spark, folder, out):
    assert runs.drain(stream(spark, folder).select("id"), out).count() == 6
    batch(spark, folder).limit(2).coalesce(1).write.mode("append").parquet(folder)
    assert runs.drain(stream(spark, folder).select("id"), out).count() == 8


def test_a_cut_line_of_a_customer_without_orders_keeps_its_key(spark, tmp_path):
    from cohortlens.catalog import q_streams
    from cohortlens.sources import star

    rows = {"customer": [(5, "a", 1, 1.0, "x"), (16, "b", 1, 1.0, "x"), (7, "c", 1, 1.0, "x"), (None, "d", 1, 1.0, "x")], "orders": [], "lineitem": []}
    for name, given in rows.items():
        spark.createDataFrame(given, star.SCHEMAS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = q_streams.stream_corrupt(spark, str(tmp_path)).collect()
    assert {(r["cust_id"], r["way"]) for r in found} == {(5, "unreadable"), (16, "unreadable"), (7, "scored"), (None, "scored")} and len(found) == 4
