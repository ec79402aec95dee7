"""Running sums, ranks and exact quantiles over values that no single task could hold.

The usual `Window.orderBy(value)` puts everything into one task. Here equal values are first counted
together, the distinct values are dealt into ranges by Spark's range partitioning (as many as there are
shuffle partitions, so they follow the size of the job), sums run inside each range, and the totals of the
ranges before it are added. Quantiles do not rank all values: a sketch brackets each of them, and only the
values inside a bracket are counted and ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.numeric import named
from cohortlens.session import materialize

ACCURACY = 2_000  # a bracket holds about 4 / ACCURACY of the rows


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join on keys, null being a key like any other; `few` says that the rows of the right side are bounded by the schema."""
    other = right.select(*[named(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[named(c) for c in right.columns if c not in keys])
    if few:
        other = F.broadcast(other)
    if not keys:
        return left.crossJoin(other)
    on = reduce(lambda a, b: a & b, [named(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    return left.join(other, on, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def value_counts(df: DataFrame, keys: list[str], value: str, counts: dict | None = None) -> DataFrame:
    """One row per (keys, value) with counts; equal values merge before the shuffle, so hot values are cheap."""
    counts = counts or {"n": F.count(F.lit(1))}
    return (
        df.where(named(value).isNotNull())
        .groupBy(*[named(k) for k in keys], named(value))
        .agg(*[c.alias(name) for name, c in counts.items()])
    )


def in_ranges(grouped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows written out in ranges of (keys, value), with the number of the range as `_range`.

    Numbers ascend with the value for each key; a key with very many values has many ranges.
    """
    ranged = grouped.repartitionByRange(*[named(k) for k in keys], named(value))
    return materialize(ranged.withColumn("_range", F.spark_partition_id()), "counts")


def prefix_sums(
    grouped: DataFrame, keys: list[str], value: str, counts: list[str], few_keys: bool = True, next_value: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Add cum_<c> (running sum up to and including the row) and tot_<c> for every count column.

    `grouped` has one row per (keys, value); it is written out in ranges once, because range totals and the sums
    themselves both read it (`stored`: it comes from `in_ranges` already). `few_keys` says that the number of keys is
    bounded by the schema, so that the range totals (one row per key and range) may be broadcast; otherwise
    Spark decides from their size at run time. `next_value` adds the next larger value of the same key.
    """
    keyless = not keys
    if keyless:
        grouped, keys = grouped.withColumn("_all", F.lit(0)), ["_all"]
    ranged = grouped if stored else in_ranges(grouped, keys, value)

    up_to = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in counts], F.min(value).alias("_low")
    )
    offsets = totals.select(
        *keys,
        "_range",
        *[(F.sum(f"_s_{c}").over(up_to) - F.col(f"_s_{c}")).alias(f"_o_{c}") for c in counts],
        *[F.sum(f"_s_{c}").over(whole).alias(f"tot_{c}") for c in counts],
        F.lead("_low").over(up_to).alias("_next_low"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    result = join_keys(ranged, offsets, [*keys, "_range"], few=few_keys).select(
        *[k for k in keys if not keyless],
        value,
        *counts,
        *[(F.col(f"_o_{c}") + F.sum(c).over(running)).alias(f"cum_{c}") for c in counts],
        *[f"tot_{c}" for c in counts],
        *([F.coalesce(F.lead(value).over(inside), "_next_low").alias("next_value")] if next_value else []),
    )
    return result


def quantile_name(p: float) -> str:
    return f"q{p:g}".replace(".", "_")


def quantile_columns(value: str, probabilities, n: str = "n"):
    """Aggregates over prefix sums that give exact, linearly interpolated quantiles."""
    first, last = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}") - 1
    total = F.col(f"tot_{n}")
    out = []
    for p in probabilities:
        position = F.lit(float(p)) * (total - 1)
        low, high = F.floor(position), F.ceil(position)
        at_low = F.max(F.when(low.between(first, last), named(value)))
        at_high = F.max(F.when(high.between(first, last), named(value)))
        share = F.max(position - low)
        out.append((at_low + (at_high - at_low) * share).alias(quantile_name(p)))
    return out


def _brackets(df: DataFrame, keys: list[str], value: str, probabilities) -> DataFrame:
    """(keys, total, low, high): number of values, and bounds between which each quantile lies, in one aggregate.

    The sketch is right within 1 / ACCURACY in rank; the bounds are two such steps apart from the quantile.
    """
    step = 2 / ACCURACY
    low = ", ".join(f"{max(p - step, 0.0)!r}D" for p in probabilities)
    high = ", ".join(f"{min(p + step, 1.0)!r}D" for p in probabilities)
    rows = df.where(named(value).isNotNull()).groupBy(*[named(k) for k in keys])
    sketch = f"percentile_approx(`{value}`, array({{}}), {ACCURACY})"
    return rows.agg(
        F.count(F.lit(1)).alias("_total"), F.expr(sketch.format(low)).alias("_low"), F.expr(sketch.format(high)).alias("_high"),
        F.min(named(value)).alias("_min"), F.max(named(value)).alias("_max"), F.lit(False).alias("_whole"))


def _inside(df: DataFrame, brackets: DataFrame, keys: list[str], value: str, probabilities: list[float], few_keys: bool) -> DataFrame:
    """(keys, _p, _v, n): counts of the values inside each bracket, and with a null _v of those below it."""
    both = join_keys(df.where(named(value).isNotNull()), brackets, keys, few=few_keys or not keys)
    v = named(value)

    def place(i: int):
        """The value if it is inside the bracket of a probability, null if below; no entry if above.

        A step of the sketch must hold a few rows for the bracket to be sure; for fewer rows it is the whole range.
        """
        few = (F.col("_total") < 4 * ACCURACY) | F.col("_whole")
        low = F.col("_min") if probabilities[i] < 2 / ACCURACY else F.when(few, F.col("_min")).otherwise(F.col("_low")[i])
        high = F.col("_max") if probabilities[i] > 1 - 2 / ACCURACY else F.when(few, F.col("_max")).otherwise(F.col("_high")[i])
        return F.when(v <= high, F.struct(F.lit(i).alias("_p"), F.when(v >= low, v).alias("_v")))

    entries = F.filter(F.array(*[place(i) for i in range(len(probabilities))]), lambda x: x.isNotNull())
    counted = both.select(*[named(k) for k in keys], F.inline(entries)).groupBy(*[named(k) for k in keys], "_p", "_v").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted, "bracketed")


def _missed(counted: DataFrame, brackets: DataFrame, keys: list[str], probabilities: list[float], few_keys: bool) -> DataFrame:
    """Groups and probabilities whose quantile does not lie inside its bracket, by the counts."""
    wanted = F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(p).alias("_at")) for i, p in enumerate(probabilities)])
    expected = brackets.select(*[named(k) for k in keys], "_total", F.inline(wanted)).where("_total > 0")
    n = F.col("n")
    held = counted.groupBy(*[named(k) for k in keys], "_p").agg(
        F.sum(F.when(F.col("_v").isNull(), n)).alias("_under"), F.sum(F.when(F.col("_v").isNotNull(), n)).alias("_in"))
    both = join_keys(expected, held, [*keys, "_p"], "left", few_keys)
    under, inside, position = F.coalesce("_under", F.lit(0)), F.coalesce("_in", F.lit(0)), F.col("_at") * (F.col("_total") - 1)
    return both.where((F.floor(position) < under) | (F.ceil(position) >= under + inside))


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities, few_keys: bool = True) -> DataFrame:
    """Exact quantiles per key, linearly interpolated, one column per probability.

    One pass brackets them, a second one counts what is below each bracket and the values inside it; only these few
    are ranked. The counts prove that every quantile lies in its bracket; a group for which a sketch was wrong is counted again
    over its whole range. NaN must have been made null.
    """
    probabilities = [float(p) for p in probabilities]
    brackets = materialize(_brackets(df, keys, value, probabilities), "brackets")
    counted = _inside(df, brackets, keys, value, probabilities, few_keys)
    missed = _missed(counted, brackets, keys, probabilities, few_keys)
    if not missed.isEmpty():
        wrong = missed.select(*[named(k) for k in keys], F.lit(True).alias("_wrong")).distinct()
        wide = materialize(join_keys(brackets, wrong, keys, "left") if keys else brackets.withColumn("_wrong", F.lit(True)), "brackets")
        counted = _inside(df, wide.withColumn("_whole", F.coalesce("_wrong", F.lit(False))).drop("_wrong"), keys, value, probabilities, few_keys)
    below = counted.where("_v IS NULL").select(*[named(k) for k in keys], "_p", F.col("n").alias("_below"))
    ranked = prefix_sums(counted.where("_v IS NOT NULL"), [*keys, "_p"], "_v", ["n"], few_keys)
    ranked = join_keys(ranked, below, [*keys, "_p"], "left", few_keys)
    ranked = join_keys(ranked, brackets, keys, few=few_keys or not keys)
    before = F.coalesce("_below", F.lit(0))
    first, last = before + F.col("cum_n") - F.col("n"), before + F.col("cum_n") - 1
    columns = []
    for i, p in enumerate(probabilities):
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        own = F.col("_p") == i
        at_low = F.max(F.when(own & low.between(first, last), F.col("_v")))
        at_high = F.max(F.when(own & high.between(first, last), F.col("_v")))
        columns.append((at_low + (at_high - at_low) * F.max(position - low)).alias(quantile_name(p)))
    return ranked.groupBy(*[named(k) for k in keys]).agg(*columns) if keys else ranked.agg(*columns)
