"""Random Fourier features: a map in which the inner product of two rows is close to their Gaussian kernel.

A linear model behind the map is a kernel model that any number of rows can train. With frequencies w drawn from the kernel's
spectrum, exp(-gamma |x - y|^2) is the mean of cos(w (x - y)); the map holds cosines and sines of `frequencies` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

FREQUENCIES = 512


def error_bound(frequencies: int = FREQUENCIES, chance: float = 0.001) -> float:
    """How far the map may be off for a pair of rows, but for this chance (Hoeffding's bound for a mean of cosines)."""
    return math.sqrt(2 * math.log(2 / chance) / frequencies)


class _Mapping(HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    frequencies = Param(Params._dummy(), "frequencies", "number of frequencies; the map has twice as many values", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0 for 1 / (features * variance of all values)", TypeConverters.toFloat)


class FourierFeatures(Estimator, _Mapping):
    """Fits the width of the kernel (if not given) and the number of features."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="mapped", frequencies=FREQUENCIES, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="mapped", frequencies=FREQUENCIES, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FourierFeaturesModel":
        values = vector_to_array(self.getInputCol())
        size = F.size(values)
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        row = dataset.agg(F.max(size).alias("wide"), (F.sum(total) / F.sum(size)).alias("mean")).head()
        gamma = self.getOrDefault(self.gamma)
        if not gamma and row["wide"]:
            off = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - row["mean"]) * (x - row["mean"]))
            variance = dataset.agg(F.sum(off) / F.sum(size)).head()[0]
            gamma = 1.0 / (row["wide"] * variance) if variance else 1.0
        return self._copyValues(FourierFeaturesModel())._set(gamma=float(gamma), wide=row["wide"] or 0)


class FourierFeaturesModel(Model, _Mapping):
    """Adds the mapped vector. The frequencies follow from the seed, so they are drawn where they are needed and never stored."""

    wide = Param(Params._dummy(), "wide", "number of features", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="mapped", frequencies=FREQUENCIES, gamma=0.0, seed=42, wide=0)

    def matrix(self) -> np.ndarray:
        """Frequencies, a column each."""
        random = np.random.default_rng(self.getOrDefault(self.seed))
        shape = (self.getOrDefault(self.wide), self.getOrDefault(self.frequencies))
        return random.standard_normal(shape) * math.sqrt(2 * self.getOrDefault(self.gamma))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = self.matrix()
        scale = 1 / math.sqrt(matrix.shape[1])

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            angles = np.stack(rows.to_numpy()) @ matrix
            return pd.Series(list(np.hstack([np.cos(angles), np.sin(angles)]) * scale))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))
