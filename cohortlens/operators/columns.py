"""Operators that only look at names and types: selection, removal, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from cohortlens import constants as C
from cohortlens.functions.numeric import named


def _parts(name: str) -> list[str]:
    return name.casefold().split("_")


def identifier_columns(names: list[str], identifiers=C.IDENTIFIER_NAMES) -> list[str]:
    """Names whose first or last parts between underscores are those of an identifier, whatever the case."""
    sought = [_parts(i) for i in identifiers]

    def ends(parts: list[str], own: list[str]) -> bool:
        return own in (parts[:len(own)], parts[-len(own):])

    return [n for n in names if any(ends(_parts(n), own) for own in sought)]


def drop_identifiers(df: DataFrame, keep: tuple[str, ...] = (), identifiers=C.IDENTIFIER_NAMES) -> DataFrame:
    """Drop identifier columns; the row key named in `keep` stays."""
    return df.drop(*[c for c in identifier_columns(df.columns, identifiers) if c not in keep])


def leakage_columns(names: list[str], leakage=C.LEAKAGE_NAMES, match: str = "token") -> list[str]:
    """Names that contain a leaking name as whole words between underscores, or as any part of the text."""
    if match not in ("token", "substring"):
        raise ValueError(f"unknown match {match!r}")
    if match == "substring":
        return [n for n in names if any(k.upper() in n.upper() for k in leakage)]
    return [n for n in names if any(f"_{k.upper()}_" in f"_{n.upper()}_" for k in leakage)]


def target_columns(names: list[str], target: str = C.TARGET) -> list[str]:
    return [n for n in names if target.upper() in n.upper()]


def drop_leakage(df: DataFrame, keep=(), target=C.TARGET, leakage=C.LEAKAGE_NAMES, match="token") -> DataFrame:
    """Drop leaking columns and every column of the target, but for those in `keep`."""
    out = set(leakage_columns(df.columns, leakage, match)) | set(target_columns(df.columns, target))
    return df.drop(*[c for c in df.columns if c in out and c not in keep])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def common_columns(a: DataFrame, b: DataFrame, numeric_only: bool = True) -> list[str]:
    """Columns of both frames, in the order of the first."""
    pool = numeric_columns(a) if numeric_only else a.columns
    other = set(b.columns)
    return [c for c in pool if c in other]


def align(df: DataFrame, columns: list[str], fill: dict[str, float] | float = 0.0, keep=()) -> DataFrame:
    """Exactly the training columns in their order: missing ones and nulls take the fill, others go."""
    have = set(df.columns)

    def value(name: str) -> Column:
        default = F.lit(fill.get(name, 0.0) if isinstance(fill, dict) else fill)
        own = F.coalesce(named(name), default) if name in have else default
        return own.cast("double").alias(name)

    return df.select(*[named(k) for k in keep], *[value(c) for c in columns])


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first rows by key; Spark keeps the top n of each task and never sorts everything."""
    return df.orderBy(key).limit(n)


def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes null in every floating column, as sources promise, or in those of `columns`."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float") and (columns is None or name in columns)}
    return df.select(
        *[F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floating else named(c) for c in df.columns]
    )
