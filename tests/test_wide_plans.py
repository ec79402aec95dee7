"""Wide panels are prepared by plans that stay small: no aggregate per cell, no column per argument."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, impute, panel, scale
from cohortlens.spec import Feature


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _constraints(df):
    return df._jdf.queryExecution().optimizedPlan().constraints().size()


def test_a_pivot_holds_one_value_per_year(spark, frame):
    long = frame("k bigint, y int, a double, `b.c` string", (1, 2000, 1.0, "x"), (1, 2000, 2.0, None), (1, 2001, None, "z"), (None, 2001, 5.0, "n"), (2, None, 7.0, "q"))
    wide = panel.to_wide(long, "k", "y", (2000, 2001), ("a", "b.c"))
    assert wide.columns == ["k", "a_2000", "a_2001", "b.c_2000", "b.c_2001"]
    assert {tuple(r) for r in wide.collect()} == {(1, 2.0, None, "x", "z"), (None, None, 5.0, None, "n"), (2, None, None, None, None)}
    years, columns = tuple(range(1990, 2000)), [f"c{i}" for i in range(12)]
    many = spark.range(4).select(F.col("id").alias("k"), F.lit(1990).alias("y"), *[F.lit(1.0).alias(c) for c in columns])
    assert _plan(panel.to_wide(many, "k", "y", years, columns)).count("max(") <= len(columns)


def test_deviations_read_their_mean_as_a_column(spark, frame):
    names = [f"c{i}" for i in range(7)]
    df = frame(", ".join(f"{c} double" for c in names), (1.0, 2.0, 4.0, None, math.nan, 8.0, 9.0), (None,) * 7, (3.0, *[None] * 6))
    made = features.build(df, [Feature("m", "row_mean", tuple(names)), Feature("s", "row_std", tuple(names))])
    assert made.columns == [*names, "m", "s"]
    rows = made.select("m", "s").collect()
    assert rows[0]["m"] == pytest.approx(4.8) and rows[0]["s"] == pytest.approx(math.sqrt(sum((x - 4.8) ** 2 for x in (1, 2, 4, 8, 9)) / 4))
    assert tuple(rows[1]) == (None, 0.0) and tuple(rows[2]) == (3.0, 0.0)
    assert "_common_expr" not in _plan(made) and len(_plan(made)) < 40_000


def test_scaling_has_as_many_aggregates_for_any_number_of_columns(spark, frame):
    df = frame("a double, `b.c` int, none double", (1.0, 2, None), (math.nan, 4, None), (3.0, None, None))
    found = {r["column"]: (r["mean"], r["std"]) for r in scale.fit(df, df.columns).collect()}
    assert found == {"a": (2.0, 1.0), "b.c": (3.0, 1.0), "none": (None, None)}
    assert {tuple(r) for r in scale.fit(df.limit(0), ["a", "none"]).collect()} == {("a", None, None), ("none", None, None)}
    wide = spark.range(3).select(*[F.lit(float(i)).alias(f"c{i}") for i in range(40)])
    assert _plan(scale.fit(wide.where("c0 = 0"), wide.columns)).count("stddev_pop(") <= 1


def test_a_gap_in_any_column_is_one_condition_per_column(spark, frame):
    """One condition over all columns has a variant for each set of them: 2 ** 12 here, more than a driver holds with 90."""
    names = [f"c{i}" for i in range(12)]
    df = spark.range(40).selectExpr("struct(id, " + ", ".join(f"if(id % 13 = {i}, NULL, id / 2D) AS {c}" for i, c in enumerate(names)) + ") AS s").selectExpr("s.id AS id", *[f"s.{c} AS {c}" for c in names])
    whole = impute.impute_all(df, "drop", ("id",))
    assert _constraints(whole) < 200 and _constraints(impute.drop_incomplete(df, names)) < 200
    assert {tuple(r) for r in whole.collect()} == {(i, *[i / 2] * 12) for i in (12, 25, 38)}
    odd = frame("k double, a double, f float, `b.c` string", (math.nan, 1.0, 1.0, "x"), (2.0, math.nan, 1.0, "x"), (3.0, 1.0, math.nan, "x"), (4.0, None, 1.0, "x"), (5.0, 1.0, 1.0, None), (None, 2.0, 2.0, ""))
    assert {tuple(r) for r in impute.impute_all(odd, "drop", ("k",)).collect()} == {(None, 1.0, 1.0, "x"), (None, 2.0, 2.0, "")}
    assert impute.drop_incomplete(odd).count() == 0 and impute.drop_incomplete(odd, ["k", "b.c"]).count() == 3 and impute.drop_incomplete(odd, []).count() == 6


def test_scaling_asks_nothing_about_the_array_of_all_columns(spark):
    """A condition on the size of an array of all columns has a variant for each set of the columns made below it."""
    names = [f"c{i}" for i in range(12)]
    made = spark.range(6).selectExpr(*[f"if(id = {i}, NULL, id * {i + 1}D) AS {c}" for i, c in enumerate(names)]).selectExpr(*[f"coalesce({c}, 0D) AS {c}" for c in names])
    found = scale.fit(made, names)
    assert "size(" not in _plan(found)
    values = [[0.0 if k == i else k * (i + 1.0) for k in range(6)] for i in range(12)]
    assert {r["column"]: (r["mean"], r["std"]) for r in found.collect()} == {
        c: (pytest.approx(sum(v) / 6), pytest.approx(math.sqrt(sum((x - sum(v) / 6) ** 2 for x in v) / 6))) for c, v in zip(names, values)}
