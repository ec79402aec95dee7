"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP = r"[\x20\x09-\x0D]+"  # what separates words; words are everything else


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % parts


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `max_bytes` of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        block = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def batch_of(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip((columns[k] for k in schema), schema.values())],
        names=list(schema))


def bounded_sample(rows: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """About `wanted` distinct rows at most, all if there are no more, the same ones in every run.

    Rows are chosen by a hash of the columns `by`, at the rate that the number of distinct hashes asks for; rows that
    agree in them count once, so copies neither break the bound nor use it up. The rows are read once to count.
    """
    hashed = rows.withColumn("sample_hash", F.xxhash64(*by))
    share = min(1.0, wanted / max(hashed.select("sample_hash").distinct().count(), 1))
    return hashed.where(F.pmod("sample_hash", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["sample_hash"])
