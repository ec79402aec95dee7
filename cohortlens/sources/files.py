"""CSV in and out, with separators, types and column order found from the data."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from cohortlens import constants as C
from cohortlens.functions.numeric import named
from cohortlens.operators.columns import without_nan

SEPARATORS = (",", ";", "\t", "|")
_WHOLE = r"^[+-]?\d+$"
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Layout:
    """Files with the same header line, and whether their quoted values may hold line breaks."""

    header: str
    breaks: bool
    paths: tuple[str, ...]


def _lines(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    reader = spark.read
    if recursive:
        reader = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
    return reader.text(path)


def layouts(spark: SparkSession, path: str, recursive: bool = False) -> list[Layout]:
    """The files below a path by header, from one pass over their lines; empty files are left out.

    A line with an odd number of quotes opens or closes a value that holds a line break. Only the files that have
    such a line are read whole by one task each.
    """
    lines = _lines(spark, path, recursive).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))) % 2
    blocks = lines.groupBy("path", "at").agg(F.first("value").alias("first"), F.max(odd).alias("odd"))
    files = blocks.groupBy("path").agg(F.min_by("first", "at").alias("header"), (F.max("odd") == 1).alias("breaks"))
    grouped: dict[tuple[str, bool], list[str]] = {}
    for r in files.orderBy("path").collect():
        grouped.setdefault((r["header"], r["breaks"]), []).append(unquote(r["path"]))
    return [Layout(header, breaks, tuple(paths)) for (header, breaks), paths in grouped.items()]


def separator_of(header: str) -> str:
    """The candidate that occurs most often in a header."""
    return max(SEPARATORS, key=header.count)


def detect_separator(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most often in the first line."""
    found = layouts(spark, path)
    if not found:
        raise ValueError(f"{path} is empty")
    return separator_of(found[0].header)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers or decimals become numbers; one pass decides for all.

    Whole numbers are bigint if all fit, else decimal(38,0) if all fit, else they stay texts: no digit is lost.
    """
    if not df.columns:
        return df
    tests = []
    for i, c in enumerate(df.columns):
        whole = named(c).rlike(_WHOLE)
        tests += [
            F.count(named(c)).alias(f"n{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count_if(whole & named(c).try_cast("bigint").isNotNull()).alias(f"b{i}"),
            F.count_if(whole & named(c).try_cast("decimal(38,0)").isNotNull()).alias(f"x{i}"),
            F.count_if(named(c).rlike(_DECIMAL)).alias(f"d{i}"),
        ]
    seen = df.agg(*tests).head()

    def typed(i, c):
        n = seen[f"n{i}"]
        if n and seen[f"w{i}"] == n:
            kind = "bigint" if seen[f"b{i}"] == n else "decimal(38,0)" if seen[f"x{i}"] == n else "string"
            return named(c).cast(kind).alias(c)
        if n and seen[f"d{i}"] == n:
            return named(c).cast("double").alias(c)
        return named(c)

    return df.select(*[typed(i, c) for i, c in enumerate(df.columns)])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str | None = None,
             recursive: bool = False, source: str | None = None) -> DataFrame:
    """A CSV file or folder with headers. Missing-value texts and NaN become null.

    Columns are matched by the header of each file, so files may order them differently; a column that a file lacks
    is null there. With a schema there is no pass to find types. `source` names a column for the file of each row.
    Other suffixes than .csv are refused.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.endswith(".csv"):
        raise ValueError(f"unsupported format: {name}")
    found = layouts(spark, path, recursive)
    if not found:
        raise ValueError(f"{path} is empty")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    extra = [F.input_file_name().alias(source)] if source else []

    def part(layout: Layout) -> DataFrame:
        own = sep or separator_of(layout.header)
        reader = spark.read.option("header", True).option("sep", own).option("escape", '"').option("multiLine", layout.breaks)
        if schema is None:
            texts = reader.option("inferSchema", False).csv(list(layout.paths))
            value = {c: F.trim(named(c)) for c in texts.columns}
            return texts.select(*[F.when(~value[c].isin(*C.MISSING_TEXTS), value[c]).alias(c) for c in texts.columns], *extra)
        kinds = {f.name: f.dataType for f in schema.fields}
        header = next(csv.reader([layout.header], delimiter=own))
        in_file = StructType()
        for c in header:
            in_file.add(c, kinds.get(c, StringType()))
        rows = reader.schema(in_file).csv(list(layout.paths))
        return rows.select(*[named(c) if c in header else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], *extra)

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(part, found))
    if schema is not None:
        return without_nan(whole)
    return infer_types(whole)


def discover_csv(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """All CSV files below a folder and its subfolders, with `source_file`; an error when there is none."""
    try:
        return read_csv(spark, folder, schema, recursive=True, source="source_file")
    except Exception as error:
        if "is empty" in str(error) or "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            raise FileNotFoundError(f"no CSV file below {folder}") from error
        raise


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path
