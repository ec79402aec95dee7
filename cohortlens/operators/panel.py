"""Wide and long panels, and the window forms of year-over-year features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.numeric import named
from cohortlens.functions.shape import unpivot
from cohortlens.spec import PanelSpec, split_year


def year_columns(names: list[str], year: int) -> list[str]:
    """Source columns of one year; derived names that carry two years do not count."""
    hits = [(n, split_year(n, (1900, 2100))) for n in names]
    return [n for n, hit in hits if hit and hit[1] == year]


def year_slice(df: DataFrame, year: int, key: str | None = None) -> DataFrame:
    """Key and columns of one year of a wide panel."""
    keep = ([key] if key else []) + year_columns(df.columns, year)
    return df.select(*[named(c) for c in keep])


def melt(df: DataFrame, ids: list[str], columns: list[str], variable="variable", value="value") -> DataFrame:
    """One (variable, value) row per id and column; null values stay."""
    return unpivot(df, ids, columns, variable, value)


def melt_years(df: DataFrame, spec: PanelSpec, stems: list[str]) -> DataFrame:
    """Wide to long: (key, indicator, year, value), null values kept."""
    columns = [f"{s}_{y}" for s in stems for y in spec.years if f"{s}_{y}" in df.columns]
    long = melt(df, [spec.key], columns, "variable", "value")
    return long.select(
        spec.key,
        F.regexp_extract("variable", r"^(.*)_\d{4}$", 1).alias("indicator"),
        F.right("variable", F.lit(4)).cast("int").alias("year"),
        "value",
    )


def to_long(df: DataFrame, spec: PanelSpec, stems: list[str], year: str = "year") -> DataFrame:
    """One row per key and year, a column per stem; years in which every stem is null are left out."""
    rows = [
        F.struct(F.lit(y).alias(year), *[
            (named(f"{s}_{y}") if f"{s}_{y}" in df.columns else F.lit(None)).alias(s) for s in stems
        ])
        for y in spec.years
    ]
    long = df.select(spec.key, F.inline(F.array(*rows)))
    return long.na.drop("all", subset=list(stems))


def to_wide(df: DataFrame, key: str, year: str, years, columns) -> DataFrame:
    """One row per key, columns {name}_{year}.

    The years are given, so there is no job to find them, and the rows are shuffled once. Each year of a key becomes one
    struct, so the aggregation by key holds one value per year and not one per cell, which Spark would not compile.
    """
    numbered = list(enumerate(columns))
    yearly = df.groupBy(key, F.expr(f"`{year}` AS _year")).agg(*[F.expr(f"max(`{c}`) AS _v{i}") for i, c in numbered])
    cells = ", ".join(f"_v{i}" for i, _ in numbered)
    rows = yearly.groupBy(key).agg(*[F.expr(f"any_value(CASE WHEN _year = {y} THEN struct({cells}) END, true) AS _y{y}") for y in years])
    return rows.select(key, *[F.expr(f"_y{y}._v{i} AS `{c}_{y}`") for i, c in numbered for y in years])


def latest_year(df: DataFrame, year: str = "year") -> DataFrame:
    return df.agg(F.max(year).alias("latest_year"))


def yearly_changes(df: DataFrame, key: str, year: str, indicators) -> DataFrame:
    """Difference to the previous available year of the same key; gaps are bridged, nulls are not years."""
    ordered = Window.partitionBy(key).orderBy(year)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", *[(named(i) - F.last(named(i), ignorenulls=True).over(before)).alias(f"{i}_diff") for i in indicators]
    )


def entity_trend(df: DataFrame, key: str, year: str, indicators) -> DataFrame:
    """Last minus first year of each key."""
    return df.groupBy(key).agg(
        *[(F.max_by(i, year) - F.min_by(i, year)).alias(f"{i}_trend") for i in indicators]
    )


def entity_moments(df: DataFrame, key: str, indicators) -> DataFrame:
    """Mean and sample deviation over the years of each key; the deviation is 0 for a single year."""
    return df.groupBy(key).agg(
        *[F.avg(i).alias(f"{i}_mean") for i in indicators],
        *[F.coalesce(F.stddev_samp(i), F.lit(0.0)).alias(f"{i}_std") for i in indicators],
    )


def entity_window(df: DataFrame, key: str, year: str, indicator: str) -> DataFrame:
    """Rank, previous value, first and last value of an indicator beside every row."""
    ordered = Window.partitionBy(key).orderBy(year)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        key,
        year,
        named(indicator),
        F.row_number().over(ordered).alias("position"),
        F.lag(indicator).over(ordered).alias("previous"),
        F.first(indicator).over(whole).alias("first_value"),
        F.last(indicator).over(whole).alias("last_value"),
    )
