"""Cross-validated linear and kernel machines, all folds and strengths side by side, as `logistic` has it for its models.

A pass over the rows gives losses and gradients of all machines that are still moving. The hinge is rounded off within `ROUND` of its
corner, so that steps of limited-memory BFGS settle; a row's loss is off by at most a quarter of that. Steps start from the
weighted Gram matrix of the rows. The machines are those that `LinearSVC` looks for, up to that rounding: weighted mean hinge loss plus
half the strength times the squared coefficients, the intercept free. Behind a kernel map the mapped rows are made in the pass that
reads them; kept, they would take many times the place of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators import logistic

ROUND = 0.05  # half the width of the rounded corner of the hinge
TOLERANCE = 1e-5  # mean loss that a step may still gain
BLOCK = 2048  # rows that are mapped at a time
FAR = 1000.0  # angles up to this size are mapped in single precision, off by less than 1e-4


@dataclass(frozen=True)
class Map:
    """A Fourier map whose width may differ by fold: `widths[f]` belongs to the machines that leave out fold f."""

    seed: int
    wide: int
    frequencies: int
    widths: tuple[float, ...]


def _views(kernel: Map | None) -> Callable:
    """A function that gives the rows of a batch as machines see them: (folds of these machines or None for all, rows, labels, weights, folds).

    `wanted` are the folds that machines leave out; with `held` they are asked about these rows, else about the others.
    """
    read, block, far = logistic.reader(), BLOCK, FAR
    if kernel is None:
        return lambda batch, wanted, held: iter([(None, *read(batch))])
    seed, shape, widths = kernel.seed, (kernel.wide, kernel.frequencies), kernel.widths

    def view(batch, wanted, held):
        x, y, w, fold = read(batch)
        base = np.random.default_rng(seed).standard_normal(shape)
        groups = {}
        for f in wanted:
            groups.setdefault(widths[f], []).append(f)
        for b in range(0, len(y), block):
            part = slice(b, b + block)
            angles = x[part, :-1] @ base
            for width, folds in groups.items():
                own = np.isin(fold[part], folds) if held else (fold[part] != folds[0]) | (len(folds) > 1)
                turned = angles[own] * width
                z = np.ones((len(turned), 2 * shape[1] + 1), np.float32 if np.abs(turned).max(initial=0.0) < far else np.float64)
                turned = turned.astype(z.dtype)
                np.cos(turned, out=z[:, :shape[1]])
                np.sin(turned, out=z[:, shape[1]:-1])
                z[:, :-1] *= 1 / math.sqrt(shape[1])
                yield folds, z, y[part][own], w[part][own], fold[part][own]

    return view


def _slopes(rows: DataFrame, points: np.ndarray, left_out: np.ndarray, kernel: Map | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted losses and gradients at a point for each machine, over the rows of all folds but its own."""
    view, corner, wanted = _views(kernel), ROUND, np.unique(left_out).tolist()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), points.shape[1] + 1))
        for batch in batches:
            for folds, x, y, w, fold in view(batch, wanted, False):
                mine = np.arange(len(points)) if folds is None else np.flatnonzero(np.isin(left_out, folds))
                sign = (2 * y - 1)[:, None]
                short = 1 - sign * (x @ points[mine].T.astype(x.dtype))
                slope = np.clip((short + corner) / (2 * corner), 0, 1)
                share = w[:, None] * (fold[:, None] != left_out[mine])
                total[mine, 0] += (share * (corner * slope * slope + np.maximum(short - corner, 0))).sum(0)
                total[mine, 1:] -= (share * sign * slope).astype(x.dtype).T @ x
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})

    total = np.zeros((len(points), points.shape[1] + 1))
    for r in rows.mapInArrow(sums, "v array<double>").collect():
        total += np.asarray(r["v"]).reshape(total.shape)
    return total[:, 0], total[:, 1:]


def _gram(rows: DataFrame, kernel: Map) -> np.ndarray:
    """Weighted Gram matrix of all mapped rows, by the map of the first fold; steps start from it, where they end does not depend on it."""
    view = _views(Map(kernel.seed, kernel.wide, kernel.frequencies, kernel.widths[:1] * len(kernel.widths)))
    folds = list(range(len(kernel.widths)))

    def mapped(batch):
        for _, x, y, w, fold in view(batch, folds, True):
            yield x, y, w, np.zeros(len(fold), np.int32)

    return logistic.grams(rows, 1, 2 * kernel.frequencies + 1, mapped)[0]


def _hits(rows: DataFrame, points: np.ndarray, left_out: np.ndarray, kernel: Map | None) -> DataFrame:
    """(model, label, prediction, n): the rows of the fold that each machine has left out, counted."""
    view, wanted = _views(kernel), np.unique(left_out).tolist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(points), 2, 2), dtype=np.int64)
        for batch in batches:
            for folds, x, y, _, fold in view(batch, wanted, True):
                for m in range(len(points)) if folds is None else np.flatnonzero(np.isin(left_out, folds)):
                    own = fold == left_out[m]
                    np.add.at(found[m], (y[own].astype(int), (x[own] @ points[m] > 0).astype(int)), 1)
        m, a, b = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"model": pa.array(m, pa.int32()), "label": pa.array(a, pa.float64()), "prediction": pa.array(b, pa.float64()), "n": pa.array(found[m, a, b], pa.int64())})

    return rows.mapInArrow(counted, "model int, label double, prediction double, n bigint").groupBy("model", "label", "prediction").agg(F.sum("n").cast("double").alias("n"))


def margins(folded: DataFrame, points: np.ndarray, features: str, label: str, weight: str, fold: str, kernel: Map | None = None) -> DataFrame:
    """(label, rawPrediction) of every row by the machine that has left out its fold; machine f leaves out fold f."""
    view, wanted = _views(kernel), list(range(len(points)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, y, _, fold in view(batch, wanted, True):
                margin = np.zeros(len(y))
                for f in wanted:
                    margin[fold == f] = x[fold == f] @ points[f]
                yield pa.RecordBatch.from_pydict({"label": pa.array(y, pa.float64()), "raw": pa.array(list(np.stack([-margin, margin], 1)), pa.list_(pa.float64()))})

    rows = logistic.narrow(folded, features, label, weight, fold).mapInArrow(found, "label double, raw array<double>")
    return rows.select(F.col("label").alias(label), array_to_vector("raw").alias("rawPrediction"))


def fold_models(folded: DataFrame, strengths: list[float], k: int, max_iter: int, features: str, label: str, weight: str, fold: str,
                kernel: Map | None = None, start: np.ndarray | None = None):
    """(machines by fold and strength as coefficients and intercept, counts of hits by machine), or None where this form does not apply.

    It applies to labels 0 and 1, finite values and at most `logistic.WIDEST` features. Machine `f * len(strengths) + i` leaves out fold f.
    All begin at `start` if there is one.
    """
    rows = logistic.narrow(folded, features, label, weight, fold).persist()
    try:
        shape = logistic.class_weights(rows, label, k)
        if shape is None or kernel is not None and shape[0] != kernel.wide + 1:
            return None
        size, weights = shape[0] if kernel is None else 2 * kernel.frequencies + 1, shape[1]
        grams = logistic.grams(rows, k, size) if kernel is None else np.stack([_gram(rows, kernel)] * k) / k
        if not np.isfinite(grams).all():
            return None
        searches, inverses = [], {}
        for f in range(k):
            own = np.delete(weights, f, 0).sum()
            for strength in strengths:
                penalty = np.append(np.full(size - 1, float(strength)), 0.0)
                if kernel is None or strength not in inverses:
                    # about as curved as a logistic loss would be
                    inverses[strength] = logistic.inverse(np.delete(grams, f, 0).sum(0) / (4 * own) + np.diag(penalty))
                at = np.zeros(size) if start is None else np.array(start, float)
                searches.append(logistic.Search(f, penalty, own, inverses[strength], at, tolerance=TOLERANCE))
        while moving := [s for s in searches if not s.done]:
            losses, slopes = _slopes(rows, np.stack([s.trial for s in moving]), np.array([s.fold for s in moving]), kernel)
            for s, loss, slope in zip(moving, losses, slopes):
                s.take(loss, slope, max_iter)
        points = np.stack([s.at for s in searches])
        return points, _hits(rows, points, np.array([s.fold for s in searches]), kernel).collect()
    finally:
        rows.unpersist()
