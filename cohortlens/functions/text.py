"""Pieces of SQL text: names, literals and row-wise formulas.

Formulas over many columns are built as text, one `expr` per result, because every Column call from
Python is a round trip to the JVM.
"""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def quoted(name: str) -> str:
    """A column name."""
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A double or a string; null for None."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(value)!r}D"


def number(name: str, dtype: DataType | None = None) -> str:
    """The column as a double; text that is not a number becomes null, and so does NaN."""
    column = quoted(name)
    if dtype is not None and not isinstance(dtype, NumericType):
        return f"if({column} RLIKE r'{_NUMBER}', try_cast(trim({column}) AS double), NULL)"
    if dtype is not None and not isinstance(dtype, (DoubleType, FloatType)):
        return f"cast({column} AS double)"
    # not nullif: Spark gives each of its arguments a column of its own
    return f"if(isnan(cast({column} AS double)), NULL, cast({column} AS double))"


def or_zero(x: str) -> str:
    return f"coalesce({x}, 0D)"


def filled(xs: list[str]) -> str:
    """How many of them are not null."""
    return "(" + " + ".join(f"if({x} IS NULL, 0, 1)" for x in xs) + ")"


def row_mean(xs: list[str]) -> str:
    """Mean over the non-null ones; null when all are null."""
    return f"try_divide({' + '.join(map(or_zero, xs))}, {filled(xs)})"


def row_std(xs: list[str], mean: str | None = None, n: str | None = None) -> str:
    """Sample deviation over the non-null ones; 0 with fewer than two. `mean` and `n` name their `row_mean` and `filled`, if there are columns of these."""
    mean, n = mean or row_mean(xs), n or filled(xs)
    squares = " + ".join(or_zero(f"({x} - {mean}) * ({x} - {mean})") for x in xs)
    return f"if({n} > 1, sqrt(({squares}) / ({n} - 1)), 0D)"


def ordinal_code(name: str, levels: dict[str, int]) -> str:
    """Level number; 0 for null and for unknown texts."""
    cases = " ".join(f"WHEN {literal(t)} THEN {code}" for t, code in levels.items())
    return f"CASE {quoted(name)} {cases} ELSE 0 END"
