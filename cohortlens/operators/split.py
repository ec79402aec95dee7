"""Exact stratified splits and folds without sorting or moving the rows.

Rows are ordered by a seeded hash of their key inside each class. A split is then a few cut points on
that order. Counting hash prefixes locates the prefix that holds each cut; only the rows with that
prefix are ranked, and every row finds its part by comparing its hash with the cuts of its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens import constants as C
from cohortlens.functions.hashing import order_hash
from cohortlens.functions.numeric import named
from cohortlens.session import materialize

_DIGITS = 4  # hash prefix: 16**4 = 65,536 buckets per class


def cut_points(df: DataFrame, label: str, key: str, fractions: list[float], seed: int) -> DataFrame:
    """(label, cuts): per class, the (hash, key) of the last row inside each fraction of its rows."""
    hashed = df.select(named(label).alias("_label"), named(key).alias("_key"), order_hash(named(key), seed).alias("_h"))
    bucketed = hashed.withColumn("_b", F.substring("_h", 1, _DIGITS))
    counts = bucketed.groupBy("_label", "_b").agg(F.count(F.lit(1)).alias("_n"))

    upto = Window.partitionBy("_label").orderBy("_b")
    whole = Window.partitionBy("_label")
    placed = counts.select(
        "_label", "_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(whole).alias("_all")
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("cut"), F.floor(F.col("_all") * F.lit(float(f)) + 0.5).alias("rank"))
        for i, f in enumerate(fractions)
    ])
    inside = F.filter(wanted, lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_n")))
    cuts = placed.select("_label", "_b", "_before", F.explode(inside).alias("_w"))

    # At most one (class, prefix) row per cut; written, so that Spark knows their size.
    candidates = bucketed.join(materialize(cuts, "cut-prefixes"), ["_label", "_b"])
    order = Window.partitionBy("_label", "_w").orderBy("_h", "_key")
    found = candidates.withColumn("_r", F.row_number().over(order)).where(
        F.col("_r") == F.col("_w.rank") - F.col("_before")
    )
    columns = [F.max(F.when(F.col("_w.cut") == i, F.struct("_h", "_key"))).alias(f"_cut{i}") for i in range(len(fractions))]
    return found.groupBy("_label").agg(*columns)


def _with_cuts(df: DataFrame, label: str, key: str, fractions: list[float], seed: int) -> DataFrame:
    cuts = materialize(cut_points(df, label, key, fractions, seed), "cuts")
    marked = df.withColumn("_at", F.struct(order_hash(named(key), seed).alias("_h"), named(key).alias("_key")))
    return marked.join(cuts, named(label) == F.col("_label"), "left")


def stratified(df: DataFrame, label: str, key: str, test_size: float = C.TEST_SIZE, seed: int = C.SEED,
               name: str = "split") -> DataFrame:
    """Add `split`: exactly round(test_size * n) rows of each class are 'test', the others 'train'."""
    cut = _with_cuts(df, label, key, [test_size], seed)
    part = F.when(F.col("_at") <= F.col("_cut0"), "test").otherwise("train")
    return cut.select(*[named(c) for c in df.columns], part.alias(name))


def folds(df: DataFrame, label: str, key: str, k: int = C.FOLDS, seed: int = C.SEED, name: str = "fold") -> DataFrame:
    """Add `fold` in 0..k-1: within a class the sizes of the folds differ by at most one row."""
    cut = _with_cuts(df, label, key, [i / k for i in range(1, k)], seed)
    number: Column = F.lit(0)
    for i in range(k - 1):
        # Without a cut (fewer rows than folds) the boundary lies before the first row.
        number = number + F.when(F.col("_at") <= F.col(f"_cut{i}"), 0).otherwise(1)
    return cut.select(*[named(c) for c in df.columns], number.cast("int").alias(name))


def by_hash(df: DataFrame, key: str, test_size: float = C.TEST_SIZE, seed: int = C.SEED, name: str = "split") -> DataFrame:
    """Add `split` from the hash alone: no counting, sizes are right on average, new rows keep their part."""
    limit = format(int(test_size * 16**12), "012x")
    part = F.when(F.substring(order_hash(named(key), seed), 1, 12) < limit, "test").otherwise("train")
    return df.select("*", part.alias(name))
