"""Data and prediction drift between a reference and a current frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.numeric import half_even, named, upper_gamma
from cohortlens.functions.shape import statistics, unpivot
from cohortlens.operators.columns import common_columns
from cohortlens.operators.impute import long_numbers
from cohortlens.operators.ranks import in_ranges, prefix_sums, quantile_columns, quantile_name, value_counts
from cohortlens.session import materialize

TINY = 1e-4  # stands in for an empty share inside logarithms


@dataclass(frozen=True)
class Thresholds:
    """Where each test sees drift: a KS p-value below, a normed Wasserstein or Jensen-Shannon distance from here on."""

    ks_p_value: float = 0.05
    wasserstein: float = 0.1
    js_distance: float = 0.1


def tagged(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Both frames in long form with `side` ('ref', 'cur')."""
    ref = long_numbers(reference, columns).withColumn("side", F.lit("ref"))
    return ref.unionByName(long_numbers(current, columns).withColumn("side", F.lit("cur")))


def side_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_ref, n_cur): the grouped form that every numeric test reads."""
    return value_counts(
        tagged(reference, current, columns), ["column"], "value",
        {"n_ref": F.count_if(F.col("side") == "ref"), "n_cur": F.count_if(F.col("side") == "cur")},
    )


def _ranked(reference, current, columns) -> DataFrame:
    counted = side_counts(reference, current, columns).withColumn("s_ref", F.col("value") * F.col("n_ref"))
    return prefix_sums(counted, ["column"], "value", ["n_ref", "n_cur", "s_ref"], next_value=True)


def _gap() -> Column:
    return F.abs(F.col("cum_n_ref").cast("double") / F.col("tot_n_ref") - F.col("cum_n_cur").cast("double") / F.col("tot_n_cur"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic, as a finite alternating series."""
    x = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x),
    )
    return F.when(x < 0.3, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def _numeric_tests(ranked: DataFrame) -> DataFrame:
    mean = F.col("tot_s_ref") / F.col("tot_n_ref")
    squares = F.sum(F.col("n_ref") * (F.col("value") - mean) * (F.col("value") - mean))
    work = _gap() * (F.coalesce("next_value", "value") - F.col("value"))
    r, c = F.col("n_ref").cast("double") / F.col("tot_n_ref"), F.col("n_cur").cast("double") / F.col("tot_n_cur")
    stats = ranked.groupBy("column").agg(
        F.max("tot_n_ref").alias("n_ref"),
        F.max("tot_n_cur").alias("n_cur"),
        F.count(F.lit(1)).alias("n_values"),
        F.max(_gap()).alias("ks"),
        F.sum(work).alias("_work"),
        F.sqrt(squares / F.max("tot_n_ref")).alias("_std"),
        F.sqrt(F.greatest(F.sum(_js_terms(r, c)), F.lit(0.0))).alias("js_distance"),
    )
    return stats.select(
        "column", "n_ref", "n_cur", "n_values", "js_distance", "ks", ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")).alias("ks_p_value"),
        (F.col("_work") / F.greatest(F.col("_std"), F.lit(0.001))).alias("wasserstein"),
    )


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_ref, n_cur, ks, ks_p_value): largest distance between the two distribution functions."""
    return _numeric_tests(_ranked(reference, current, columns)).select("column", "n_ref", "n_cur", "ks", "ks_p_value")


def wasserstein(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, wasserstein): area between the distribution functions over the reference deviation."""
    return _numeric_tests(_ranked(reference, current, columns)).select("column", "wasserstein")


def binned(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """(column, bin, n_ref, n_cur, tot_ref, tot_cur) over reference quantiles; each edge closes its bin.

    Edges are exact. With `accuracy` they come from one sketch per column, right within 1/accuracy in rank,
    and no distinct value is shuffled: the choice for continuous columns of very many rows.
    """
    inner = [i / bins for i in range(1, bins)]
    if accuracy is None:
        counted = in_ranges(side_counts(reference, current, columns), ["column"], "value")
        ranked = prefix_sums(counted, ["column"], "value", ["n_ref", "n_cur"], stored=True)
        edges = ranked.groupBy("column").agg(*quantile_columns("value", inner, "n_ref"))
        edges = edges.select("column", F.array(*[quantile_name(p) for p in inner]).alias("_edges"))
        sums = [F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")]
    else:
        counted = tagged(reference, current, columns).where("value is not null")
        edges = statistics(
            reference, columns, _edges=f"percentile_approx(cast({{c}} AS double), array({', '.join(f'{p!r}D' for p in inner)}), {accuracy})"
        )
        is_ref = F.col("side") == "ref"
        sums = [F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_cur")]
    spot = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    # one row of edges per column of the schema
    placed = counted.join(F.broadcast(edges), "column").withColumn("bin", spot)
    whole = Window.partitionBy("column")  # at most `bins` rows per column
    return placed.groupBy("column", "bin").agg(*sums).select(
        "*", F.sum("n_ref").over(whole).alias("tot_ref"), F.sum("n_cur").over(whole).alias("tot_cur")
    )


def _share(n: str, whole: str) -> Column:
    return F.greatest(F.col(n).cast("double") / F.col(whole), F.lit(TINY))


def psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """(column, psi): population stability index over reference quantile bins."""
    r, c = _share("n_ref", "tot_ref"), _share("n_cur", "tot_cur")
    return binned(reference, current, columns, bins, accuracy).groupBy("column").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def _js_terms(n_ref: Column, n_cur: Column) -> Column:
    def part(a, b):
        return F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)

    return 0.5 * (part(n_ref, n_cur) + part(n_cur, n_ref))


def js(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """(column, js_distance): square root of the Jensen-Shannon divergence (base 2) over the same bins."""
    r, c = F.col("n_ref").cast("double") / F.col("tot_ref"), F.col("n_cur").cast("double") / F.col("tot_cur")
    total = F.sum(_js_terms(r, c))
    return binned(reference, current, columns, bins, accuracy).groupBy("column").agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("js_distance"))


def category_side_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_ref, n_cur) over texts of both frames."""
    def long(df, side):
        texts = unpivot(df.select(*[named(c).cast("string").alias(c) for c in columns]), [], columns)
        return texts.where("value is not null").withColumn("side", F.lit(side))

    both = long(reference, "ref").unionByName(long(current, "cur"))
    return both.groupBy("column", "value").agg(
        F.count_if(F.col("side") == "ref").alias("n_ref"), F.count_if(F.col("side") == "cur").alias("n_cur")
    )


def chi2(reference: DataFrame, current: DataFrame, columns: list[str], level: float = 0.05) -> DataFrame:
    """(column, n_ref, n_cur, chi2, dof, p_value, drift_detected): two-sample chi-square on categories.

    With expected counts e = row total * side total / total, the sum of (o - e)^2 / e over both sides is
    sum(o_ref^2 / row) * t / t_ref + sum(o_cur^2 / row) * t / t_cur - t, so one aggregation is enough.
    The p-value is the tail of the chi-square distribution; drift is a p-value below `level`. With a single category it is 1.
    """
    row = (F.col("n_ref") + F.col("n_cur")).cast("double")
    sums = category_side_counts(reference, current, columns).groupBy("column").agg(
        F.sum(F.col("n_ref").cast("double") * F.col("n_ref") / row).alias("_r"),
        F.sum(F.col("n_cur").cast("double") * F.col("n_cur") / row).alias("_c"),
        F.sum("n_ref").alias("n_ref"),
        F.sum("n_cur").alias("n_cur"),
        (F.count(F.lit(1)) - 1).alias("dof"),
    )
    t = (F.col("n_ref") + F.col("n_cur")).cast("double")
    value = F.greatest(F.col("_r") * t / F.col("n_ref") + F.col("_c") * t / F.col("n_cur") - t, F.lit(0.0))
    tail = F.when(F.col("dof") > 0, upper_gamma(F.col("dof") / 2, F.col("chi2") / 2)).otherwise(1.0)
    return sums.select("column", "n_ref", "n_cur", value.alias("chi2"), "dof").withColumn("p_value", tail).withColumn("drift_detected", F.col("p_value") < level)


def moments_shift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ref_mean, cur_mean, ref_std, cur_std, shift): shift of the mean in reference deviations."""
    def pick(side, fn):
        return fn(F.when(F.col("side") == side, F.col("value")))

    stats = tagged(reference, current, columns).where("value is not null").groupBy("column").agg(
        pick("ref", F.avg).alias("ref_mean"), pick("cur", F.avg).alias("cur_mean"),
        pick("ref", F.stddev_pop).alias("ref_std"), pick("cur", F.stddev_pop).alias("cur_std"),
    )
    shift = F.when(F.col("ref_std") > 0, (F.col("cur_mean") - F.col("ref_mean")) / F.col("ref_std"))
    return stats.withColumn("shift", shift)


TESTS = {"ks": "ks_p_value", "wasserstein": "wasserstein", "js_distance": "js_distance"}


def report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None,
           limits: Thresholds = Thresholds(), test: str | dict[str, str] = "wasserstein") -> DataFrame:
    """One row per common numeric column: all statistics, the named test with its score and threshold, and its verdict.

    `test` is one of TESTS for all columns, or one per column (others by Wasserstein distance). It never depends on
    the data, so a feature is judged alike at every size. Both frames are scanned once; every test reads the counts per
    distinct value.
    """
    named_tests = test if isinstance(test, dict) else {}
    default = "wasserstein" if isinstance(test, dict) else test
    if unknown := {default, *named_tests.values()} - set(TESTS):
        raise ValueError(f"unknown tests {sorted(unknown)}; known are {sorted(TESTS)}")
    if columns is None:
        columns = common_columns(reference, current)
    if not columns:
        raise ValueError("the frames share no numeric column")
    tests = _numeric_tests(_ranked(reference, current, columns))
    chosen = F.lit(default)
    for column, own in named_tests.items():
        chosen = F.when(F.col("column") == column, own).otherwise(chosen)

    def of_test(value) -> Column:
        out = F.lit(None).cast("double")
        for name, statistic in TESTS.items():
            out = F.when(F.col("test") == name, value(statistic)).otherwise(out)
        return out

    score, threshold = of_test(F.col), of_test(lambda statistic: F.lit(getattr(limits, statistic)))
    decided = tests.withColumn("test", chosen).withColumn("score", score).withColumn("threshold", threshold)
    verdict = F.when(F.col("test") == "ks", F.col("score") < F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    return decided.select(
        "column", "n_ref", "n_cur", "ks", "ks_p_value", "wasserstein", "js_distance", "test", "score", "threshold", verdict.alias("drift_detected"))


def report_files(spark, reference_path: str, current_path: str, limits: Thresholds = Thresholds(),
                 test: str | dict[str, str] = "wasserstein") -> tuple[DataFrame, DataFrame]:
    """(feature report, one summary row) of two CSV paths; `status` says why there is no verdict.

    A missing side or frames without a common numeric column give an empty report and a summary with a status, so a
    scheduled check always leaves a record.
    """
    from cohortlens.sources import files

    sides = []
    for name, path in (("reference", reference_path), ("current", current_path)):
        try:
            sides.append(files.discover_csv(spark, path) if not path.endswith(".csv") else files.read_csv(spark, path))
        except Exception as error:
            if not isinstance(error, (FileNotFoundError, ValueError)) and "PATH_NOT_FOUND" not in str(error):
                raise
            return _no_report(spark, f"no {name} data")
    columns = common_columns(*sides)
    if not columns:
        return _no_report(spark, "no common numeric column")
    features = report(*sides, columns, limits, test)
    return features, summary(features).withColumn("status", F.lit("compared"))


def _no_report(spark, status: str) -> tuple[DataFrame, DataFrame]:
    features = spark.createDataFrame([], (
        "column string, n_ref bigint, n_cur bigint, ks double, ks_p_value double, wasserstein double, js_distance double, "
        "test string, score double, threshold double, drift_detected boolean"))
    return features, summary(features).withColumn("status", F.lit(status))


def summary(features: DataFrame) -> DataFrame:
    """One row: any drift, names of the drifted columns, how many were analysed and how many drifted."""
    drifted = F.when(F.col("drift_detected"), F.col("column"))
    return features.agg(
        F.coalesce(F.max("drift_detected"), F.lit(False)).alias("drift_detected"),
        F.sort_array(F.collect_list(drifted)).alias("drifted_features"),
        F.count(F.lit(1)).alias("n_features_analyzed"),
        F.count(drifted).alias("n_features_drifted"),
    )


def prediction_drift(reference: DataFrame, current: DataFrame, column: str, threshold: float = 0.1) -> DataFrame:
    """One row: means and population deviations of both sides; drift when the means differ by more than the threshold."""
    sides = reference.select(F.lit("ref").alias("side"), named(column).alias("v")).unionByName(
        current.select(F.lit("cur").alias("side"), named(column).alias("v"))
    )
    return prediction_drift_sides(sides, F.col("side") == "ref", F.col("side") == "cur", "v", threshold)


def prediction_drift_sides(df: DataFrame, is_ref: Column, is_cur: Column, column: str, threshold: float = 0.1) -> DataFrame:
    """The same when one frame holds both sides: a single pass over it."""
    v = named(column)
    stats = df.agg(
        F.avg(F.when(is_ref, v)).alias("rm"), F.avg(F.when(is_cur, v)).alias("cm"),
        F.stddev_pop(F.when(is_ref, v)).alias("rs"), F.stddev_pop(F.when(is_cur, v)).alias("cs"),
    )
    diff = F.abs(F.col("cm") - F.col("rm"))
    return stats.select(
        (diff > threshold).alias("drift_detected"),
        half_even(F.col("rm"), 4).alias("reference_mean"),
        half_even(F.col("cm"), 4).alias("current_mean"),
        half_even(diff, 4).alias("mean_difference"),
        half_even(F.col("rs"), 4).alias("reference_std"),
        half_even(F.col("cs"), 4).alias("current_std"),
        F.lit(float(threshold)).alias("threshold"),
    )
