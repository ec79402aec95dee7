"""A generated wide panel whose values depend on (row, column, seed) only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens import constants as C
from cohortlens.functions.hashing import normal, uniform
from cohortlens.functions.numeric import clip, half_even

# Ranges, choices and rates of the generated columns.
YEARS = (2020, 2021, 2022)
ORDINAL_CHOICES = ("Quartzo", "Ágata", "Ametista", "Topázio")
GROUP_CHOICES = ("A", "B", "C", "D", "E")
SCORE_LOW, SCORE_HIGH, SCORE_NOISE = 2.0, 9.0, 0.5
AGE_LOW, AGE_HIGH = 7, 18
PHASES = 9
TENURE_LOW, TENURE_HIGH = 1, 8
TURNING_RATE, SCHOLARSHIP_RATE, NULL_RATE = 0.3, 0.2, 0.05
RISK_CUT = 5.0


def generate(spark: SparkSession, n: int = 500, seed: int = C.SEED, key: str = "row_id", null_rate: float = NULL_RATE,
             years=YEARS) -> DataFrame:
    """n rows of scores, ages, levels, groups and a target that follows two of the scores."""
    row = F.col(key)

    def u(name: str) -> Column:
        return uniform(row, name, seed)

    def whole(name, low, high):
        return (F.floor(u(name) * (high - low)) + low).cast("int")

    def choice(name, options):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u(name) * len(options)) + 1).cast("int"))

    def full(y):
        out = {}
        for s in C.SCORE_INDICATORS:
            name = f"{s}_{y}"
            raw = u(name) * (SCORE_HIGH - SCORE_LOW) + SCORE_LOW + normal(row, name, seed) * SCORE_NOISE
            out[name] = half_even(clip(raw, 0.0, 10.0), 2)
        out[f"{C.AGE}_{y}"] = whole(f"{C.AGE}_{y}", AGE_LOW, AGE_HIGH) + (y - years[0])
        out[f"{C.ORDINAL}_{y}"] = choice(f"{C.ORDINAL}_{y}", ORDINAL_CHOICES)
        out[f"{C.PHASE}_{y}"] = whole(f"{C.PHASE}_{y}", 0, PHASES)
        out[f"{C.GROUP}_{y}"] = choice(f"{C.GROUP}_{y}", GROUP_CHOICES)
        out[f"{C.TURNING_POINT}_{y}"] = F.when(u(f"{C.TURNING_POINT}_{y}") < TURNING_RATE, 1).otherwise(0)
        out[f"{C.SCHOLARSHIP}_{y}"] = F.when(u(f"{C.SCHOLARSHIP}_{y}") < SCHOLARSHIP_RATE, 1).otherwise(0)
        out[f"{C.TENURE}_{y}"] = whole(f"{C.TENURE}_{y}", TENURE_LOW, TENURE_HIGH)
        return out

    columns: dict[str, Column] = {}
    for y in years:
        columns.update(full(y))
    base = spark.range(n).select(F.col("id").alias(key)).select(key, *[c.alias(name) for name, c in columns.items()])

    targets = {}
    for y in years:
        risk = (10.0 - F.col(f"INDE_{y}")) * 0.4 + (10.0 - F.col(f"IAA_{y}")) * 0.3 + u(f"risk_{y}") * 3.0
        targets[f"{C.TARGET}_{y}"] = F.when(risk > RISK_CUT, 1).otherwise(0)

    def with_nulls(name, column):
        if name.startswith((C.ORDINAL, C.GROUP)):
            return column.alias(name)
        return F.when(u(f"{name}/null") >= null_rate, column).alias(name)

    ordered = [name for y in years for name in [*[c for c in columns if c.endswith(f"_{y}")], f"{C.TARGET}_{y}"]]
    return base.select(key, *[with_nulls(name, targets.get(name, F.col(name))) for name in ordered])
