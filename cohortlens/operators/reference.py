"""A stored profile of the reference side of drift checks.

Each day of a frame shrinks to one row per column: counts, moments, range, a sketch of the distribution (KLL) and one of the
distinct values (HLL). Rows of several days merge into one per column. A check reads these few rows and the current frame once;
the reference itself is never read again. Exact tests on both frames are in `drift`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.functions.shape import present
from cohortlens.functions.text import literal
from cohortlens.operators.drift import Thresholds, ks_p_value

#: Size of the sketches; with it a rank is off by no more than `rank_error` in 99 of 100 cases.
K = 800
GRID = 512  # places at which two distributions are compared

PROFILE = "column string, n bigint, n_null bigint, mean double, m2 double, low double, high double, kll binary, hll binary"


def rank_error(k: int = K) -> float:
    """Error of a rank from one sketch as a share of its rows, at 99 % (known fit for this kind of sketch)."""
    return 2.296 / k ** 0.9021


def ks_error(k: int = K) -> float:
    """How far `ks` from two sketches may be off: a rank error and a step of the grid on each side."""
    return 2 * rank_error(k) + 2 / GRID


def summarise(df: DataFrame, columns: list[str], by: list[str] = (), k: int = K) -> DataFrame:
    """(by, column, n, n_null, mean, m2, low, high, kll, hll) in one pass; NaN is null, columns without values have null sketches."""
    kinds = dict(df.dtypes)
    cells = []
    for i, c in enumerate(columns):
        x = F.expr(f"cast({present(c, kinds[c])} AS double)")
        cells += [
            F.count(x).alias(f"n{i}"), (F.count(F.lit(1)) - F.count(x)).alias(f"e{i}"), F.avg(x).alias(f"a{i}"),
            (F.var_pop(x) * F.count(x)).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
            F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, k)).alias(f"k{i}"), F.when(F.count(x) > 0, F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)))).alias(f"d{i}")]
    wide = df.groupBy(*by).agg(*cells)
    rows = ", ".join(f"{literal(c)}, n{i}, e{i}, a{i}, v{i}, l{i}, h{i}, k{i}, d{i}" for i, c in enumerate(columns))
    return wide.select(*by, F.expr(f"stack({len(columns)}, {rows}) AS (column, n, n_null, mean, m2, low, high, kll, hll)"))


def merge(profiles: DataFrame, k: int = K) -> DataFrame:
    """One row per column from the rows of several days; moments merge without cancellation."""
    some = F.col("n") > 0
    total = profiles.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    both = profiles.join(F.broadcast(total), "column")  # one row per column of the schema
    return both.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.when(F.max(some), F.kll_merge_agg_double("kll", k)).alias("kll"), F.when(F.max(some), F.hll_union_agg("hll")).alias("hll"))


def store(df: DataFrame, columns: list[str], time: str, path: str, k: int = K) -> None:
    """Write the profile of each day of `df` below `path`; a day that is there already is replaced."""
    daily = summarise(df.withColumn("profile_day", F.to_date(time)), columns, ["profile_day"], k)
    daily.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_day").parquet(path)


def load(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, k: int = K) -> DataFrame:
    """The merged profile of the days from `since` to before `until`; only their folders are read."""
    days = spark.read.schema(f"{PROFILE}, profile_day date").parquet(path)
    if since:
        days = days.where(F.col("profile_day") >= F.lit(since).cast("date"))
    if until:
        days = days.where(F.col("profile_day") < F.lit(until).cast("date"))
    return merge(days.drop("profile_day"), k)


def compare(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two profiles: column, n_ref, n_cur, means, deviations, distinct values, ks, ks_p_value, wasserstein.

    `ks` is right within `ks_error`. The distance is the mean gap of the quantiles over the reference deviation.
    """
    def side(df, tag):
        return df.where("n > 0").select("column", *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "m2", "kll", "hll")])

    both = side(reference, "ref").join(F.broadcast(side(current, "cur")), "column")  # one row per column of the schema
    middle = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    points = both.select("*", *[F.kll_sketch_get_quantile_double(f"kll_{t}", middle).alias(f"_{t}") for t in ("ref", "cur")])

    def reached(side: str, x: Column) -> Column:
        """Share of a side up to x, by its quantiles."""
        return F.size(F.filter(side, lambda q: q <= x)) / GRID

    gaps = F.transform(F.array_distinct(F.concat("_ref", "_cur")), lambda x: F.abs(reached("_ref", x) - reached("_cur", x)))
    spans = F.zip_with("_ref", "_cur", lambda a, b: F.abs(a - b))
    work = F.aggregate(spans, F.lit(0.0), lambda s, x: s + x) / GRID
    std = F.sqrt(F.col("m2_ref") / F.col("n_ref"))
    return points.select(
        "column", "n_ref", "n_cur", F.col("mean_ref").alias("ref_mean"), F.col("mean_cur").alias("cur_mean"), std.alias("ref_std"), F.sqrt(F.col("m2_cur") / F.col("n_cur")).alias("cur_std"),
        F.hll_sketch_estimate("hll_ref").alias("ref_distinct"), F.hll_sketch_estimate("hll_cur").alias("cur_distinct"),
        F.array_max(gaps).alias("ks"), (work / F.greatest(std, F.lit(0.001))).alias("wasserstein"),
    ).withColumn("ks_p_value", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def check(reference: DataFrame, current: DataFrame, columns: list[str], limits: Thresholds = Thresholds(), test: str = "wasserstein", k: int = K) -> DataFrame:
    """A stored profile against a frame, which is read once: the columns of `compare`, threshold and drift_detected."""
    if test not in ("ks", "wasserstein"):
        raise ValueError(f"unknown test {test!r}; known are ['ks', 'wasserstein']")
    found = compare(reference, summarise(current, columns, k=k))
    limit = F.lit(limits.ks_p_value if test == "ks" else limits.wasserstein)
    verdict = F.col("ks_p_value") < limit if test == "ks" else F.col("wasserstein") >= limit
    return found.withColumn("test", F.lit(test)).withColumn("threshold", limit).withColumn("drift_detected", verdict)
