"""A log by days that finds its newest rows without reading the rest.

Every append is a folder of its own with one partition per day, sorted by time, newest first; a manifest names the folders of
each day and how many rows they hold. The newest N rows are in the newest days whose counts reach N, so only these are opened.
Appends leave many small files; `compact` rewrites a day as a bounded number of sorted ones.

One writer at a time. A reader sees an append, or a compaction, when its manifest is there; the folders of the manifest before it
stay until the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortlens.sources import logs
from cohortlens.sources.manifests import Manifests


class IndexedLog:
    """Rows of `schema` (the prediction log if not said) below `root`, by the day of `time`."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType = logs.PREDICTION_LOG, time: str = "timestamp", files: int = 1):
        self.spark, self.root, self.time, self.files = spark, root, time, files
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.manifests = Manifests(spark, root)

    def days(self) -> dict[str, dict]:
        """Day -> {parts: folders, n: rows}; rows without a time are in the day `__HIVE_DEFAULT_PARTITION__`."""
        return self.manifests.last().get("days", {})

    def _write(self, rows: DataFrame, number: int) -> dict[str, int]:
        """Write rows to a folder of their own; rows by day."""
        day = F.date_format(F.to_date(self.time), "yyyy-MM-dd")
        dealt = rows.select(self.schema.names).withColumn("_day", day).repartition("_day", F.pmod(F.xxhash64(self.time), F.lit(self.files)))
        path = f"{self.root}/rows/_part={number}"
        dealt.sortWithinPartitions("_day", F.desc(self.time)).write.mode("overwrite").partitionBy("_day").parquet(path)
        written = self.spark.read.schema(StructType([*self.schema.fields]).add("_day", "string")).parquet(path)
        return {r["_day"] or "__HIVE_DEFAULT_PARTITION__": r["count"] for r in written.groupBy("_day").count().collect()}

    def _commit(self, number: int, days: dict, before: dict) -> None:
        self.manifests.commit(number, {"days": days, "older": before.get("days", {})})
        # folders that neither this manifest nor the one before it names
        named = {(d, p) for table in (days, before.get("days", {})) for d, e in table.items() for p in e["parts"]}
        for day, entry in before.get("older", {}).items():
            for part in entry["parts"]:
                if (day, part) not in named:
                    self.manifests.drop(f"rows/_part={part}/_day={day}")
        self.manifests.forget()

    def _next(self) -> tuple[int, dict]:
        known = self.manifests.numbers()
        return (known[-1] + 1 if known else 0), self.manifests.last()

    def append(self, rows: DataFrame) -> None:
        number, before = self._next()
        days = dict(before.get("days", {}))
        for day, n in self._write(rows, number).items():
            old = days.get(day, {"parts": [], "n": 0})
            days[day] = {"parts": [*old["parts"], number], "n": old["n"] + n}
        self._commit(number, days, before)

    def compact(self, parts: int = 4) -> list[str]:
        """Rewrite the days that lie in more than `parts` folders; returns their names."""
        number, before = self._next()
        days = dict(before.get("days", {}))
        many = sorted(d for d, e in days.items() if len(e["parts"]) > parts)
        if many:
            for day, n in self._write(self._open(days, many), number).items():
                days[day] = {"parts": [number], "n": n}
            self._commit(number, days, before)
        return many

    def _open(self, days: dict, wanted: list[str]) -> DataFrame:
        paths = [f"{self.root}/rows/_part={p}/_day={d}" for d in wanted for p in days[d]["parts"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """All rows, or those of the days from `since` to before `until`."""
        days = self.days()
        return self._open(days, [d for d in days if (since is None or d >= since) and (until is None or d < until)])

    def newest_days(self, n: int) -> list[str]:
        """The newest days that hold at least n rows with a time, or all days."""
        days, taken, found = self.days(), [], 0
        for day in sorted((d for d in days if not d.startswith("_")), reverse=True):
            if found >= n:
                break
            taken.append(day)
            found += days[day]["n"]
        if found < n:
            taken += [d for d in days if d.startswith("_")]
        return taken

    def latest(self, n: int, *ties: str | Column) -> DataFrame:
        """The newest n rows; `ties` orders rows of the same time. Rows without a time come last."""
        rows = self._open(self.days(), self.newest_days(n))
        return rows.orderBy(F.desc_nulls_last(self.time), *ties).limit(n)
