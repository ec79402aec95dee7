"""Fill values: fitted as one row of statistics, applied as a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.numeric import named
from cohortlens.functions.shape import statistics, unpivot
from cohortlens.functions.text import quoted
from cohortlens.operators.columns import numeric_columns, text_columns, without_nan
from cohortlens.operators.ranks import quantile_name, quantiles
from cohortlens.operators.select import order_statistics
from cohortlens.session import materialize


def long_numbers(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    """(ids, column, value) with numbers as doubles; NaN counts as null."""
    values = [f"nullif(cast({quoted(c)} AS double), double('NaN')) AS {quoted(c)}" for c in columns]
    return unpivot(df.selectExpr(*map(quoted, ids), *values), list(ids), columns)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fill): exact interpolated medians."""
    found, _ = order_statistics(df, columns, [0.5])
    return df.sparkSession.createDataFrame([(c, q[0]) for c, q in zip(columns, found) if q[0] is not None], "column string, fill double")


def approximate_medians(df: DataFrame, columns: list[str], accuracy: int = 10000) -> DataFrame:
    """(column, fill) in one pass and within 1/accuracy in rank, where exact values are not needed."""
    return statistics(df, columns, fill=f"percentile_approx(cast({{c}} AS double), 0.5D, {accuracy})")


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    return statistics(df, columns, fill="avg(nullif(cast({c} AS double), double('NaN')))")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fill): the most frequent text, the smallest one on ties. All-null columns have no row."""
    texts = unpivot(df.select(*[named(c) for c in columns]), [], columns).where("value is not null")
    counted = texts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("fill"))


FITS = {"median": medians, "approx_median": approximate_medians, "mean": means, "mode": modes}


def fit(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    if how not in FITS:
        raise ValueError(f"unknown strategy {how!r}; one of {sorted(FITS)}")
    return FITS[how](df, list(columns))


def as_row(stats: DataFrame, columns: list[str], value: str = "fill") -> DataFrame:
    """(column, value) rows as one struct with a field per column, for use as a scalar subquery."""
    fields = [F.max(F.when(F.col("column") == c, F.col(value))).alias(c) for c in columns]
    return stats.agg(*fields).select(F.struct(*[named(c) for c in columns]).alias("stats"))


def apply(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Replace nulls (and NaN) by the fitted values. The statistics are one row, read once per task."""
    fitted = df.select("*", as_row(stats, columns).scalar().alias("_fill"))
    kinds = dict(df.dtypes)

    def value(c):
        if c not in columns:
            return named(c)
        own = named(c)
        if kinds[c] in ("double", "float"):
            own = F.when(~F.isnan(own), own)
        return F.coalesce(own, F.col("_fill").getField(c)).alias(c)

    return fitted.select(*[value(c) for c in df.columns])


def impute(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    return apply(df, fit(df, columns, how), list(columns))


def fitted_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Medians of the group of each row, for long panels; rows without a group are a group, NaN counts as null.

    The medians are written first, so the join with the rows knows their size: few groups are broadcast and
    the rows stay where they are.
    """
    found = quantiles(long_numbers(df, columns, [group]), [group, "column"], "value", [0.5], few_keys=False)
    wide = found.groupBy(group).agg(
        *[F.max(F.when(F.col("column") == c, F.col(quantile_name(0.5)))).alias(f"_fill_{c}") for c in columns]
    )
    wide = materialize(wide, "medians")
    joined = df.alias("r").join(wide.withColumnRenamed(group, "_group"), named(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(*[
        F.coalesce(F.nanvl(named(c).cast("double"), F.lit(None)), F.col(f"_fill_{c}")).alias(c) if c in columns else named(c) for c in df.columns
    ])


def impute_all(df: DataFrame, how: str = "median", keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns at once: numbers by `how`, texts by their mode, or with `drop` only the rows without a gap.

    Columns named in `keep` are left alone and do not count as gaps.
    """
    own = [c for c in df.columns if c not in keep]
    if how == "drop":
        return without_nan(drop_incomplete(df, own), list(keep))
    numbers = [c for c in numeric_columns(df) if c in own]
    texts = [c for c in text_columns(df) if c in own]
    filled = apply(df, fit(df, numbers, how), numbers) if numbers else df
    return apply(filled, fit(df, texts, "mode"), texts) if texts else filled


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows with no null or NaN at all, or none in the named columns.

    One condition per column: of a single one over all columns (`na.drop`) Spark derives a variant for each set of them.
    """
    own = df.columns if subset is None else subset
    kinds = df.select(*[named(c) for c in own]).dtypes
    whole = [f"{quoted(c)} IS NOT NULL" + (f" AND NOT isnan({quoted(c)})" if kind in ("double", "float") else "") for c, (_, kind) in zip(own, kinds)]
    return df.where(" AND ".join(whole)) if whole else df
