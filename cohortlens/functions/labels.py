"""Class names and risk levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlens import constants as C


def risk_level(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(C.RISK_LEVELS[1])).otherwise(F.lit(C.RISK_LEVELS[0]))


def class_name(label: Column, names: dict[int, str] = C.CLASS_NAMES) -> Column:
    out = label.cast("string")
    for code, text in names.items():
        out = F.when(label == code, F.lit(text)).otherwise(out)
    return out
