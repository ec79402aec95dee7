"""Standard scaling with the population deviation, fitted on the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.numeric import named
from cohortlens.functions.shape import present, statistics
from cohortlens.functions.text import literal

_PLAIN = {"double", "float", "bigint", "int", "smallint", "tinyint"}


def fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) from one pass, NaN counting as null.

    Tasks turn their rows into (column, value) and add these up by column: a handful of aggregates, however many columns there are.
    """
    kinds = dict(df.dtypes)
    if not columns or any(kinds[c] not in _PLAIN for c in columns):
        return statistics(df, columns, mean="avg({c})", std="stddev_pop({c})")
    cells = ", ".join(f"cast({present(c, kinds[c])} AS double)" for c in columns)
    # no column for the array: Spark would ask for its size first, and derive a variant of that for each set of columns below it
    values = df.selectExpr(f"posexplode(array({cells})) AS (i, v)").where("v IS NOT NULL")
    found = values.groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    # one row, so that a column without values has its row too
    whole = found.agg(F.expr("map_from_entries(collect_list(struct(i, struct(mean, std)))) AS found"))
    names = whole.selectExpr("found", f"posexplode(array({', '.join(literal(c) for c in columns)})) AS (i, column)")
    return names.selectExpr("column", "found[i].mean AS mean", "found[i].std AS std")


def apply(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std; a constant column is only centred."""
    moments = F.struct(F.col("mean"), F.col("std"))
    fields = [F.max(F.when(F.col("column") == c, moments)).alias(c) for c in columns]
    row = stats.agg(*fields).select(F.struct(*[named(c) for c in columns]))
    both = df.select("*", row.scalar().alias("_scale"))

    def value(c):
        if c not in columns:
            return named(c)
        mean, std = F.col("_scale").getField(c)["mean"], F.col("_scale").getField(c)["std"]
        return ((named(c) - mean) / F.when(std == 0, 1.0).otherwise(std)).alias(c)

    return both.select(*[value(c) for c in df.columns])
