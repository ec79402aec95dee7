"""The binary target: which column, which rows, which classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens import constants as C
from cohortlens.functions.numeric import named

MODES = ("negative_is_risk", "already_binary", "detect")


def resolve(names: list[str], year: int | None, target: str = C.TARGET) -> str:
    """The target column of the year if there is one, else the last by name of all that begin with the target."""
    wanted = None if year is None else f"{target}_{year}"
    found = max((n for n in names if n == wanted or n.upper().startswith(target)), key=lambda n: (n == wanted, n), default=None)
    if found is None:
        raise ValueError(f"no target column {target!r} among {names}")
    return found


def is_multivalued(df: DataFrame, column: str) -> bool:
    """More than two distinct values? Looks at distinct values until it has seen three."""
    return df.where(named(column).isNotNull()).select(named(column)).distinct().limit(3).count() > 2


def binarize(df: DataFrame, column: str, mode: str = "negative_is_risk", label: str = "label") -> DataFrame:
    """Drop rows without a target and add the label: 1 for a negative value, or the 0/1 value itself.

    `detect` looks for a third value and takes the first rule if there is one. Where the values are to be labels
    already, others than 0 and 1 are an error when the rows are read.
    """
    if mode not in MODES:
        raise ValueError(f"unknown target mode {mode!r}; one of {MODES}")
    if mode == "detect":
        mode = "negative_is_risk" if is_multivalued(df, column) else "already_binary"
    value = named(column)
    if mode == "negative_is_risk":
        out = F.when(value < 0, 1).otherwise(0)
    else:
        wrong = F.concat(F.lit(f"{column} is not 0 or 1: "), value.cast("string"))
        out = F.when(value.isin(0, 1), value).otherwise(F.raise_error(wrong).cast("int"))
    return df.where(value.isNotNull()).withColumn(label, out.cast("int"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share). The window runs over one row per class."""
    counts = df.where(named(label).isNotNull()).groupBy(named(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())).alias("share"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.where(named(label).isNotNull()).groupBy(named(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy()  # one row per class
    share = F.sum("n").over(classes).cast("double") / (F.count(F.lit(1)).over(classes) * F.col("n"))
    return counts.select("label", "n", share.alias("weight"))
