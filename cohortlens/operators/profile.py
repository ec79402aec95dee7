"""Profiling: nulls, descriptive statistics, counts, histograms, box plots and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.numeric import divide, named
from cohortlens.functions.shape import present, statistics, unpivot
from cohortlens.functions.text import literal, quoted
from cohortlens.operators import gram
from cohortlens.operators.impute import long_numbers
from cohortlens.operators.ranks import join_keys, quantiles
from cohortlens.operators.select import doubles, order_statistics
from cohortlens.session import materialize

PAIRS = 100  # correlations in one aggregate, so that generated code stays within the limits of the JVM


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_nulls, n_rows) from one pass over the data."""
    columns = columns or df.columns
    return statistics(df, columns, n_nulls="count(1) - count({c})", n_rows="count(1)")


def null_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("n_nulls").alias("total_nulls"))


def null_top(df: DataFrame, k: int = 20) -> DataFrame:
    """Columns with the most nulls; columns without any do not appear."""
    return null_counts(df).where("n_nulls > 0").select("column", "n_nulls").orderBy(F.desc("n_nulls"), "column").limit(k)


def null_percent(df: DataFrame, k: int = 30) -> DataFrame:
    share = divide(F.col("n_nulls") * 100, F.col("n_rows"))
    return (
        null_counts(df).where("n_nulls > 0").select("column", share.alias("null_pct"))
        .orderBy(F.desc("null_pct"), "column").limit(k)
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, null cells and their percentage."""
    totals = null_counts(df).agg(F.max("n_rows").alias("n_rows"), F.sum("n_nulls").alias("null_cells"))
    width = len(df.columns)
    cells = F.col("n_rows") * width
    return totals.select(
        "n_rows", F.lit(width).cast("bigint").alias("n_columns"), cells.alias("n_cells"), "null_cells",
        divide(F.col("null_cells") * 100, cells).alias("null_pct"),
    )


def type_histogram(df: DataFrame) -> DataFrame:
    """(dtype, n_columns); read from the schema, without a job on the data."""
    kinds: dict[str, int] = {}
    for _, kind in df.dtypes:
        kinds[kind] = kinds.get(kind, 0) + 1
    return df.sparkSession.createDataFrame(sorted(kinds.items()), "dtype string, n_columns bigint")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per column, exact; columns without values have no row."""
    quartiles, moments = order_statistics(df, columns, [0.25, 0.5, 0.75])
    rows = [(c, m.n, m.mean, m.std, m.low, *q, m.high) for c, q, m in zip(columns, quartiles, moments) if m.n]
    kind = "column string, count bigint, mean double, std double, min double, q0_25 double, q0_5 double, q0_75 double, max double"
    return df.sparkSession.createDataFrame(rows, kind)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the non-null values, most frequent first."""
    counts = df.where(named(column).isNotNull()).groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def category_counts_many(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for several columns from one pass."""
    texts = unpivot(df.select(*[named(c).cast("string").alias(c) for c in columns]), [], columns)
    return texts.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, n_distinct), nulls not counted.

    Exact counts go through (column, value) groups, which share out evenly; one row per column comes back.
    """
    if approximate:
        return statistics(df, columns, n_distinct="approx_count_distinct({c})")
    return category_counts_many(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def yearly_means(df: DataFrame, year: str, indicators) -> DataFrame:
    """One row per year with the mean of each indicator (long panel)."""
    return df.groupBy(year).agg(*[F.avg(named(i)).alias(i) for i in indicators])


def yearly_means_wide(df: DataFrame, years, indicators) -> DataFrame:
    """The same from a wide panel: one pass, then a row per year."""
    row = df.agg(*[F.avg(named(f"{i}_{y}")).alias(f"{i}_{y}") for i in indicators for y in years])
    rows = [F.struct(F.lit(y).alias("year"), *[named(f"{i}_{y}").alias(i) for i in indicators]) for y in years]
    return row.select(F.inline(F.array(*rows)))


def _corr(a: str, b: str) -> str:
    """Pearson's correlation of the rows where both are present; null where a side is constant (its deviation need not come out as 0)."""
    left, right = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    corr = f"covar_pop({a}, {b}) / nullif(stddev_pop({left}) * stddev_pop({right}), 0D)"
    return f"CASE WHEN min({left}) < max({left}) AND min({right}) < max({right}) THEN {corr} END"


def correlations(df: DataFrame, columns: list[str], both_ways: bool = False) -> DataFrame:
    """(a, b, corr) for every pair a before b (or in both orders); a pair uses the rows where both are present, NaN is null.

    One pass over the data, however many columns: up to PAIRS pairs are columns of one aggregate, more go through `gram`.
    """
    if len(columns) < 2:
        raise ValueError("a correlation needs two columns")
    pairs = list(combinations(range(len(columns)), 2))
    if len(pairs) > PAIRS:
        found = gram.correlations(df, columns)
    else:
        kinds = dict(df.dtypes)
        values = [f"cast({present(c, kinds[c])} AS double)" for c in columns]
        row = df.selectExpr(*[f"{_corr(values[a], values[b])} AS p{k}" for k, (a, b) in enumerate(pairs)])
        cells = ", ".join(f"{literal(columns[a])}, {literal(columns[b])}, p{k}" for k, (a, b) in enumerate(pairs))
        found = row.selectExpr(f"stack({len(pairs)}, {cells}) AS (a, b, corr)")
    if not both_ways:
        return found
    return found.select(F.inline(F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The full matrix in long form: both triangles and the diagonal."""
    cells = ", ".join(f"{literal(c)}, {literal(c)}, 1D" for c in columns)
    diagonal = df.sparkSession.range(1).selectExpr(f"stack({len(columns)}, {cells}) AS (a, b, corr)")
    return correlations(df, columns, both_ways=True).unionByName(diagonal)


def top_pairs(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The pairs with the largest correlations."""
    return correlations(df, columns).where("corr is not null").orderBy(F.desc("corr"), "a", "b").limit(k)


def correlation_with(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, abs_corr) with the label, from one pass."""
    return statistics(df, columns, abs_corr=f"abs({_corr('cast({c} AS double)', f'cast({quoted(label)} AS double)')})")


def _ranges(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column, n, min, max) from one wide aggregate; pairs without values have no row."""
    kinds = dict(df.dtypes)
    values = [f"cast({present(c, kinds[c])} AS double)" for c in columns]
    cells = [F.expr(f"{fn}({v})").alias(f"{fn}{i}") for i, v in enumerate(values) for fn in ("count", "min", "max")]
    rows = ", ".join(f"{literal(c)}, count{i}, min{i}, max{i}" for i, c in enumerate(columns))
    wide = df.groupBy(*[named(b) for b in by]).agg(*cells)
    return wide.select(*[named(b) for b in by], F.expr(f"stack({len(columns)}, {rows}) AS (column, n, min, max)")).where("n > 0")


def histogram(df: DataFrame, columns: list[str], bins: int, by: list[str] = ()) -> DataFrame:
    """(by, column, bin, low, high, n): equal-width bins over the observed range; empty bins have no row.

    One wide aggregate finds the ranges, a second pass counts bins; at most one row per bin and task is shuffled.
    """
    by = list(by)
    keys = [*by, "column"]
    ranges = materialize(_ranges(df, columns, by).select(*keys, F.col("min").alias("_min"), F.col("max").alias("_max")), "ranges")
    long = long_numbers(df, columns, by).where("value is not null")
    both = join_keys(long, ranges, keys, few=not by)  # without groups one row per column of the schema
    width = (F.col("_max") - F.col("_min")) / bins
    spot = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_min")) / width), F.lit(bins - 1))).otherwise(0)
    out = both.groupBy(*keys, spot.cast("int").alias("bin"), "_min", width.alias("_width")).agg(F.count(F.lit(1)).alias("n"))
    low = F.col("_min") + F.col("bin") * F.col("_width")
    return out.select(*keys, "bin", low.alias("low"), (low + F.col("_width")).alias("high"), "n")


def _fences(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column, size, range, quartiles, fences), written out: joins then know how small (or large) they are.

    Without groups the quartiles come from radix selection over `df`, which holds doubles already; with groups from brackets.
    """
    spread = F.col("q0_75") - F.col("q0_25")
    if by:
        long = long_numbers(df, columns, by).where("value is not null")
        boxes = join_keys(_ranges(df, columns, by), quantiles(long, [*by, "column"], "value", [0.25, 0.5, 0.75], False), [*by, "column"])
    else:
        quartiles, moments = order_statistics(df, columns, [0.25, 0.5, 0.75], stored=True)
        rows = [(c, m.n, m.low, m.high, *q) for c, q, m in zip(columns, quartiles, moments) if m.n]
        boxes = df.sparkSession.createDataFrame(rows, "column string, n bigint, min double, max double, q0_25 double, q0_5 double, q0_75 double")
    return materialize(boxes.select("*", (F.col("q0_25") - 1.5 * spread).alias("low_fence"), (F.col("q0_75") + 1.5 * spread).alias("high_fence")), "boxes")


def box_stats(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers (last values inside 1.5 spreads) and the number of outliers per (by, column)."""
    by = list(by)
    keys = [*by, "column"]
    df = doubles(df, columns, by)
    boxes = _fences(df, columns, by)
    long = long_numbers(df, columns, by).where("value is not null")
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    tails = join_keys(long, boxes.select(*keys, "low_fence", "high_fence"), keys, few=not by).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return join_keys(boxes, tails, keys, few=not by).select(
        *keys, "n", "min", "low_whisker", F.col("q0_25").alias("q1"), F.col("q0_5").alias("median"),
        F.col("q0_75").alias("q3"), "high_whisker", "max", "n_outliers",
    )


def box_outliers(df: DataFrame, columns: list[str], ids: list[str], by: list[str] = ()) -> DataFrame:
    """(ids, by, column, value): the points outside the fences of their box."""
    by = list(by)
    keys = [*by, "column"]
    df = doubles(df, columns, [*ids, *by])
    fences = _fences(df, columns, by).select(*keys, "low_fence", "high_fence")
    long = long_numbers(df, columns, [*ids, *by]).where("value is not null")
    outside = ~F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return join_keys(long, fences, keys, few=not by).where(outside).select(*ids, *keys, "value")
