"""Correlations of very many columns from masked Gram blocks.

A task turns a batch into three matrices, the values less a fixed number per column (0 where there is none), their squares and
the mask of what is there. Four products of these hold, for every pair of columns, the number of rows with both, both sums, both
sums of squares and the sum of products over just those rows. A task adds up its batches and sends one row per pair; the
rows are added by pair. One pass, no row is shuffled, and the work of a row is that of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.shape import present
from cohortlens.functions.text import quoted

_SUMS = ("n", "sa", "sb", "qa", "qb", "p")
_SCHEMA = "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS)


def _products(wide: int, shift: list[float]):
    upper = np.triu_indices(wide, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, wide, wide))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide) - shift
            mask = ~np.isnan(x)
            x = np.where(mask, x, 0.0)
            mask = mask.astype(np.float64)
            sums += (mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x)
        n, s, q, p = sums
        columns = (n[upper], s[upper], s.T[upper], q[upper], q.T[upper], p[upper])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)) for i in upper] + [pa.array(c) for c in columns], names=["a", "b", *_SUMS])

    return run


def correlations(df: DataFrame, columns: list[str], start: int = 1000) -> DataFrame:
    """(a, b, corr) for every pair a before b, over the rows where both are present; NaN is null, also as a result.

    Values are taken less the first ones among `start` rows, so that large values with small deviations keep their digits. A pair
    with less than two rows or a constant side has no correlation.
    """
    kinds = dict(df.dtypes)
    rows = df.selectExpr(*[f"cast({present(c, kinds[c])} AS double) AS {quoted(c)}" for c in columns])
    held = rows.limit(start).agg(*[F.first(F.expr(quoted(c)), True) for c in columns]).head()
    shift = [0.0 if v is None or not np.isfinite(v) else float(v) for v in held]
    arrays = rows.select(F.expr(f"array({', '.join(map(quoted, columns))})").alias("v"))
    sums = arrays.mapInArrow(_products(len(columns), shift), _SCHEMA).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.nullif(F.col("n"), F.lit(0.0))
    left, right = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    corr = (F.col("p") - F.col("sa") * F.col("sb") / n) / F.sqrt(left * right)
    names = F.array(*[F.lit(c) for c in columns])
    safe = F.when((n > 1) & (F.col("qa") > 0) & (F.col("qb") > 0) & (left > 0) & (right > 0), corr)
    return sums.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), safe.alias("corr"))
