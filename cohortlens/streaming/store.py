"""Tables that a stream keeps up to date, batch by batch.

A batch writes to a folder of its own, named by its number, and then one small manifest that says which folders hold. A
reader sees the batch when its manifest is there. A batch that is repeated after a failure starts from the manifest
before it and writes the same folder again, so every batch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortlens.sources.manifests import Manifests


class DayTable:
    """Rows in folders by day, replaced a day at a time.

    The manifest names the batch whose folder holds each day. Only the days that a batch touches are read and written;
    folders that the last two manifests do not name are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, time: str, files: int = 1):
        self.spark, self.root, self.schema, self.files = spark, root, schema, files
        self.day: Column = F.date_format(F.to_date(time), "yyyy-MM-dd")
        self.manifests = Manifests(spark, root)

    def read(self, days: list[str] | None = None, before: int | None = None) -> DataFrame:
        held = self.manifests.last(before).get("days", {})
        paths = [f"{self.root}/rows/_batch={b}/_day={d}" for d, b in held.items() if days is None or d in days]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, changes: DataFrame, keys: list[str], batch: int) -> None:
        """Put the rows of `changes` in place of those with the same keys; nulls in keys are equal."""
        days = sorted(r[0] for r in changes.select(self.day).distinct().collect())
        if not days:
            return
        before = self.manifests.last(batch)
        old = self.read(days, batch).alias("o")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        kept = old.join(changes.select(keys).alias("c"), on=_all(same), how="left_anti")
        merged = kept.unionByName(changes.select(self.schema.names)).withColumn("_day", self.day)
        spread = F.pmod(F.xxhash64(*keys), F.lit(self.files))
        merged.repartition("_day", spread).write.mode("overwrite").partitionBy("_day").parquet(f"{self.root}/rows/_batch={batch}")
        self.manifests.commit(batch, {"days": {**before.get("days", {}), **dict.fromkeys(days, batch)}, "older": before.get("days", {})})
        # a reader of the manifest before this one still finds its folders
        for day, number in before.get("older", {}).items():
            if before["days"][day] != number:
                self.manifests.drop(f"rows/_batch={number}/_day={day}")
        self.manifests.forget()


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
