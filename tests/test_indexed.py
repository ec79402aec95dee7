import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.sources.indexed import IndexedLog


@pytest.fixture
def rows(spark):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("id") * 3600)
    return spark.range(240).select("id", F.when(F.col("id") % 100 != 99, at).alias("timestamp"), (F.col("id") % 2).alias("v"))


@pytest.fixture
def log(spark, rows, tmp_path):
    log = IndexedLog(spark, str(tmp_path / "log"), rows.schema)
    for part in range(3):
        log.append(rows.where(F.col("id") % 3 == part))
    return log


def ids(df):
    return [r["id"] for r in df.collect()]


def test_the_newest_rows_open_only_the_newest_days(rows, log):
    newest = log.latest(30, F.desc("id"))
    assert ids(newest) == [i for i in range(239, 0, -1) if i % 100 != 99][:30]
    assert log.newest_days(30) == ["2024-01-10", "2024-01-09"]
    text = newest._sc._jvm.PythonSQLUtils.explainString(newest._jdf.queryExecution(), "formatted")
    assert "2024-01-10" in text and "2024-01-08" not in text and "2024-01-01" not in text
    assert len(newest.inputFiles()) == 6  # two days of three appends
    assert sorted(ids(log.latest(1000, F.desc("id")))) == list(range(240))
    assert sorted(ids(log.read("2024-01-02", "2024-01-03"))) == list(range(24, 48))


def test_compaction_bounds_the_files_and_keeps_the_rows(rows, log):
    before = sorted(ids(log.read()))
    assert log.compact(3) == [] and len(log.compact(1)) == 11
    assert sorted(ids(log.read())) == before == list(range(240))
    assert len(log.latest(30).inputFiles()) == 2 and log.compact(1) == []
    log.append(rows.where("id = 0").withColumn("timestamp", F.lit("2024-02-01").cast("timestamp")))
    # the second manifest after a compaction drops the folders that it replaced
    assert len(glob.glob(f"{log.root}/rows/*/_day=2024-01-0*")) == 9
    assert ids(log.latest(1)) == [0] and sum(e["n"] for e in log.days().values()) == 241


def test_files_are_sorted_newest_first(spark, log):
    log.compact(1)
    for path in glob.glob(f"{log.root}/rows/_part=3/_day=2024*/*.parquet"):
        times = [r["timestamp"] for r in spark.read.parquet(path).collect()]
        assert times == sorted(times, reverse=True)


def test_an_append_without_manifest_does_not_count(spark, rows, log):
    log._write(rows.limit(5), 7)
    assert log.read().count() == 240
    log.append(rows.limit(1))
    assert log.read().count() == 241


def test_empty_log(spark, rows, tmp_path):
    log = IndexedLog(spark, str(tmp_path / "none"), rows.schema)
    assert log.latest(5).count() == 0 and log.read().count() == 0 and log.compact() == []
    log.append(rows.limit(0))
    assert log.latest(5).count() == 0 and os.path.isdir(log.root)
