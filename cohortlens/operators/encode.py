"""Ordinal and label encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens import constants as C
from cohortlens.functions.numeric import named
from cohortlens.functions.shape import unpivot
from cohortlens.functions.text import ordinal_code, quoted
from cohortlens.operators.ranks import prefix_sums
from cohortlens.session import materialize


def ordinal_columns(df: DataFrame, stem: str = C.ORDINAL) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string" and stem in c.upper()]


def ordinal(df: DataFrame, columns: list[str], levels=C.ORDINAL_LEVELS) -> DataFrame:
    """Replace level names by their numbers."""
    return df.selectExpr(*[f"{ordinal_code(c, levels)} AS {quoted(c)}" if c in columns else quoted(c) for c in df.columns])


def catalog(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, index): distinct texts in code point order, numbered from 0.

    The numbering runs in value ranges, so a column may have any number of distinct values. The result is a
    written table: its size is known when it is joined, and Spark broadcasts it only when that is small.
    """
    texts = unpivot(df.select(*[named(c).cast("string").alias(c) for c in columns]), [], columns)
    distinct = texts.where("value is not null").groupBy("column", "value").agg(F.lit(1).cast("bigint").alias("n"))
    ranked = prefix_sums(distinct, ["column"], "value", ["n"])
    return materialize(ranked.select("column", "value", (F.col("cum_n") - 1).cast("bigint").alias("index")), "classes")


def apply(df: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Replace texts by their index, row by row; null and unseen texts become -1. One join per column.

    All other columns pass the joins as one struct, so a join copies them as a whole and not one by one.
    Where a join shuffles, null texts are spread by a hash of their row, so they do not meet in one task.
    """
    rest = [c for c in df.columns if c not in columns]
    packed = [F.struct(*[named(c) for c in rest]).alias("_rest")] if rest else []
    out, codes = df.select(*packed, *[named(c).alias(f"_text{i}") for i, c in enumerate(columns)]), {}
    row = out.columns
    for i, c in enumerate(columns):
        text = F.col(f"_text{i}")
        own = classes.where(F.col("column") == c).select(F.col("value").alias(f"_value{i}"), F.col("index").alias(f"_index{i}"), F.lit(0).alias(f"_spread{i}"))
        spread = F.when(text.isNull(), 1 + F.pmod(F.xxhash64(*row), F.lit(1 << 20))).otherwise(0).cast("int")
        out = out.join(own, (text.cast("string") == F.col(f"_value{i}")) & (spread == F.col(f"_spread{i}")), "left")
        codes[c] = F.coalesce(f"_index{i}", F.lit(-1)).cast("bigint").alias(c)
    return out.select(*[codes[x] if x in codes else F.col("_rest").getField(x).alias(x) for x in df.columns])


def apply_like_batch(df: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Parity option: one unseen (or null) text sets the whole column to 0."""
    coded = apply(df, classes, columns)
    worst = coded.agg(F.struct(*[F.min(named(c)).alias(c) for c in columns])).scalar()
    both = coded.select("*", worst.alias("_worst"))
    return both.select(*[
        F.when(F.col("_worst").getField(c) < 0, 0).otherwise(named(c)).cast("bigint").alias(c) if c in columns else named(c)
        for c in df.columns
    ])
