"""Bounds that records have to respect: valid rows, quarantine and a count per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens import constants as C
from cohortlens.functions.numeric import named
from cohortlens.functions.text import literal, quoted


def panel_rules(columns: list[str], years, bounds=C.CONTRACT_BOUNDS) -> dict[str, tuple[float, float]]:
    """Bounds of every yearly column that the frame has."""
    have = set(columns)
    return {f"{s}_{y}": b for s, b in bounds.items() for y in years if f"{s}_{y}" in have}


def _broken(rules: dict[str, tuple[float, float]]) -> Column:
    names = [F.when(~named(c).between(low, high), F.lit(c)) for c, (low, high) in rules.items()]
    return F.array_compact(F.array(*names))


def check(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Add `violations`: names of the columns out of bounds. Null fields are optional and never violate."""
    return df.select("*", _broken(rules).alias("violations"))


def split(df: DataFrame, rules: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    checked = check(df, rules)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    return valid, checked.where(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(rule, low, high, n_violations), one row per rule from a single pass; no row is exploded."""
    counts = df.selectExpr(*[
        f"count_if({quoted(c)} NOT BETWEEN {low} AND {high}) AS _{i}" for i, (c, (low, high)) in enumerate(rules.items())
    ])
    rows = ", ".join(f"{literal(c)}, {float(low)}D, {float(high)}D, _{i}" for i, (c, (low, high)) in enumerate(rules.items()))
    return counts.selectExpr(f"stack({len(rules)}, {rows}) AS (rule, low, high, n_violations)")
