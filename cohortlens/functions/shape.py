"""Columns to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.functions.numeric import named
from cohortlens.functions.text import literal, quoted


def present(name: str, kind: str) -> str:
    """The column as SQL text, with NaN as null if it can hold any."""
    return f"nullif({quoted(name)}, cast('NaN' AS {kind}))" if kind in ("double", "float") else quoted(name)


def statistics(df: DataFrame, columns: list[str], **formulas: str) -> DataFrame:
    """(column, statistic, ...) rows from one wide aggregate: formulas hold {c} for the column, in which NaN is null.

    A single pass with a fixed number of aggregates per column; only its one row is turned into rows.
    """
    names = list(formulas)
    kinds = dict(df.dtypes)
    plain = {c: present(c, kinds[c]) for c in columns}
    cells = [f"{formula.format(c=plain[c])} AS _{i}_{n}" for i, c in enumerate(columns) for n, formula in formulas.items()]
    rows = ", ".join(f"{literal(c)}, " + ", ".join(f"_{i}_{n}" for n in names) for i, c in enumerate(columns))
    return df.selectExpr(*cells).selectExpr(f"stack({len(columns)}, {rows}) AS (column, {', '.join(names)})")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], variable: str = "column", value: str = "value") -> DataFrame:
    """One (ids, variable, value) row per row and column; null values stay, names may hold dots."""
    return df.unpivot([named(i) for i in ids], [named(c) for c in columns], variable, value)
