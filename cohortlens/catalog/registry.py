"""Registered queries: name -> (Spark callable, DuckDB statement or none)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.session import with_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with_scratch(spark).conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


# Comparison keeps six decimals. The half is moved a little, so that values which lie exactly between two
# results round the same way on both engines, whatever their last bit is.
_HALF = 0.50000017


def rounded(df: DataFrame) -> DataFrame:
    """Doubles with six decimals, times without a zone."""
    def value(c, kind):
        if kind == "double":
            return F.expr(f"floor(`{c}` * 1000000.0D + {_HALF}D) / 1000000.0D AS `{c}`")
        if kind == "timestamp":
            return F.col(c).cast("timestamp_ntz").alias(c)
        return F.col(c)

    return df.select(*[value(c, kind) for c, kind in df.dtypes])


def r6(expression: str, alias: str | None = None) -> str:
    """The same rounding as DuckDB text."""
    text = f"(floor(CAST({expression} AS DOUBLE) * 1000000.0::DOUBLE + {_HALF}::DOUBLE) / 1000000.0::DOUBLE)"
    return text + (f" AS {alias}" if alias else "")
