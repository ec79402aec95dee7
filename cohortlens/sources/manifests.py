"""Small numbered files that say which folders of a table hold."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    """Small JSON files by batch number below `root`; the last two are kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        found = self._system.listStatus(folder) if self._system.exists(folder) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def last(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of a batch before that one; empty if there is none."""
        known = [n for n in self.numbers() if before is None or n < before]
        if not known:
            return {}
        stream = self._system.open(self._path(f"{self.root}/manifest/{known[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, batch: int, content: dict) -> None:
        """Publish a batch; the file has its name only when it is whole."""
        partial, whole = self._path(f"{self.root}/manifest/_{batch}"), self._path(f"{self.root}/manifest/{batch}")
        stream = self._system.create(partial, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._system.delete(whole, False)
        self._system.rename(partial, whole)

    def drop(self, path: str) -> None:
        self._system.delete(self._path(f"{self.root}/{path}"), True)

    def forget(self) -> None:
        """Drop all manifests but the last two."""
        for number in self.numbers()[:-2]:
            self.drop(f"manifest/{number}")
