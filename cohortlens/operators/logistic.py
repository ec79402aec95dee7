"""Cross-validated logistic regressions, all folds and strengths side by side.

Single fits read the rows once for each step of each of them. Here a pass gives losses and gradients of all models that are still
moving, so rows are read as often as the slowest one takes steps. Steps are those of limited-memory BFGS. They start from a bound of the
curvature: p (1 - p) is at most 1/4, so one weighted Gram matrix for each fold bounds that of all models that leave it out, and
columns that depend on each other cost no steps. The models are the optima that `LogisticRegression` looks for: weighted mean loss plus
half the strength times the squared coefficients, the intercept free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

WIDEST = 500  # features; Gram matrices are held by task and fold
TOLERANCE = 1e-9  # mean loss that a step may still gain
MEMORY = 10  # steps that directions remember


def reader():
    """Rows with a 1 behind them, labels, weights and folds of a batch. What tasks run is nested, so it travels with them."""
    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        y, w, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        return np.hstack([x, np.ones((len(y), 1))]), y, w, fold

    return read


def grams(rows: DataFrame, k: int, size: int, parts: Callable | None = None) -> np.ndarray:
    """Weighted Gram matrix of each fold. Tasks send rows of it, which meet by fold and row. `parts` gives what is read of a batch piece by piece."""
    read, kind = reader(), "fold int, i int, v array<double>"
    parts = parts or (lambda batch: iter([read(batch)]))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size, size))
        for x, _, w, fold in (part for batch in batches for part in parts(batch)):
            for f in np.unique(fold):
                own = x[fold == f]
                sums[f] += own.T @ (own * w[fold == f, None]).astype(x.dtype)
        for f, total in enumerate(sums):
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array(np.full(size, f, np.int32)), "i": pa.array(np.arange(size, dtype=np.int32)),
                "v": pa.array(list(total), pa.list_(pa.float64()))})

    def added(group: pa.Table) -> pa.Table:
        row = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).sum(0)
        return pa.table({"fold": group["fold"][:1], "i": group["i"][:1], "v": pa.array([row], pa.list_(pa.float64()))})

    out = np.zeros((k, size, size))
    for r in rows.mapInArrow(products, kind).groupBy("fold", "i").applyInArrow(added, kind).collect():
        out[r["fold"], r["i"]] = r["v"]
    return out


def _slopes(rows: DataFrame, points: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted losses and gradients at a point for each model, over the rows of all folds but its own."""
    read = reader()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), points.shape[1] + 1))
        for batch in batches:
            x, y, w, fold = read(batch)
            sign = (1 - 2 * y)[:, None]
            t = sign * (x @ points.T)
            share = w[:, None] * (fold[:, None] != left_out)
            small = np.exp(-np.abs(t))
            total[:, 0] += (share * (np.maximum(t, 0) + np.log1p(small))).sum(0)
            total[:, 1:] += (share * sign * np.where(t >= 0, 1, small) / (1 + small)).T @ x
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})

    total = np.zeros((len(points), points.shape[1] + 1))
    for r in rows.mapInArrow(sums, "v array<double>").collect():
        total += np.asarray(r["v"]).reshape(total.shape)
    return total[:, 0], total[:, 1:]


@dataclass
class Search:
    """A model on its way: the point it has reached and the step that is tried."""

    fold: int
    penalty: np.ndarray
    weight: float
    bound: np.ndarray  # inverse of the curvature bound
    at: np.ndarray
    tolerance: float = TOLERANCE
    loss: float = np.inf
    slope: np.ndarray | None = None
    move: np.ndarray | None = None
    length: float = 0.0
    steps: int = 0
    done: bool = False
    past: list = field(default_factory=list)

    @property
    def trial(self) -> np.ndarray:
        return self.at if self.move is None else self.at + self.length * self.move

    def take(self, loss: float, slope: np.ndarray, most: int) -> None:
        """What was found at the trial point; the next trial is a new step or half of this one."""
        point = self.trial
        loss = loss / self.weight + 0.5 * float(self.penalty @ (point * point))
        slope = slope / self.weight + self.penalty * point
        if self.move is not None:
            if not loss <= self.loss + 1e-4 * self.length * float(self.slope @ self.move):
                self.length /= 2
                self.done = self.length < 1e-6
                return
            s, y = point - self.at, slope - self.slope
            if s @ y > 1e-300:
                self.past = [*self.past, (s, y, 1 / (s @ y))][-MEMORY:]
            self.steps += 1
        self.at, self.loss, self.slope = point, loss, slope
        self.done = 0.5 * float(slope @ self.bound @ slope) <= self.tolerance or self.steps >= most
        self.move, self.length = self._direction(), 1.0

    def _direction(self) -> np.ndarray:
        q, used = self.slope.copy(), []
        for s, y, r in reversed(self.past):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        z = self.bound @ q
        if self.past:
            s, y, _ = self.past[-1]
            z *= (s @ y) / (y @ self.bound @ y)
        for (s, y, r), a in zip(self.past, reversed(used)):
            z += s * (a - r * (y @ z))
        return -z


def inverse(curvature: np.ndarray) -> np.ndarray:
    """Inverse, of equal scale in all columns; directions without any curvature keep a little."""
    scale = 1 / np.sqrt(np.maximum(np.diag(curvature), np.finfo(float).tiny))
    values, vectors = np.linalg.eigh(curvature * scale[:, None] * scale)
    return (vectors / np.maximum(values, values.max() * 1e-12)) @ vectors.T * scale[:, None] * scale


def _hits(rows: DataFrame, points: np.ndarray, left_out: np.ndarray) -> DataFrame:
    """(model, label, prediction, n): the rows of the fold that each model has left out, counted."""
    read = reader()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(points), 2, 2), dtype=np.int64)
        for batch in batches:
            x, y, _, fold = read(batch)
            for m, point in enumerate(points):
                own = fold == left_out[m]
                # a model of one class has no slope and an endless intercept
                high = (x[own, :-1] @ point[:-1] + point[-1]) > 0
                np.add.at(found[m], (y[own].astype(int), high.astype(int)), 1)
        m, a, b = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"model": pa.array(m, pa.int32()), "label": pa.array(a, pa.float64()), "prediction": pa.array(b, pa.float64()), "n": pa.array(found[m, a, b], pa.int64())})

    return rows.mapInArrow(counted, "model int, label double, prediction double, n bigint").groupBy("model", "label", "prediction").agg(F.sum("n").cast("double").alias("n"))


def narrow(folded: DataFrame, features: str, label: str, weight: str, fold: str) -> DataFrame:
    """The columns that `reader` reads."""
    return folded.select(vector_to_array(features).alias("x"), label, F.col(weight).cast("double").alias("w"), F.col(fold).cast("int").alias("f"))


def class_weights(rows: DataFrame, label: str, k: int) -> tuple[int, np.ndarray] | None:
    """Features with the 1 behind them, and weights by fold and class; None for rows that cannot be fitted side by side."""
    classes = rows.groupBy("f", label).agg(F.sum("w").alias("w"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("wide")).collect()
    wide = {r[c] for r in classes for c in ("low", "wide")}
    if len(wide) != 1 or max(wide) > WIDEST or any(r[label] not in (0.0, 1.0) or not np.isfinite(r["w"]) for r in classes):
        return None
    weights = np.zeros((k, 2))
    for r in classes:
        weights[r["f"], int(r[label])] = r["w"]
    for f in range(k):
        if not np.delete(weights, f, 0).any():
            raise ValueError(f"The training data at fold {f} is empty.")
    return wide.pop() + 1, weights


def fold_models(folded: DataFrame, strengths: list[float], k: int, max_iter: int, features: str, label: str, weight: str, fold: str):
    """(models by fold and strength as coefficients and intercept, counts of hits by model), or None where this form does not apply.

    It applies to labels 0 and 1, finite values and at most 500 features. Model `f * len(strengths) + i` leaves out fold f.
    """
    rows = narrow(folded, features, label, weight, fold).persist()
    try:
        shape = class_weights(rows, label, k)
        if shape is None:
            return None
        size, weights = shape
        sums = grams(rows, k, size)
        if not np.isfinite(sums).all():
            return None
        searches = []
        for f in range(k):
            own = np.delete(weights, f, 0).sum(0)
            curvature = np.delete(sums, f, 0).sum(0) / (4 * own.sum())
            for strength in strengths:
                penalty = np.append(np.full(size - 1, float(strength)), 0.0)
                start = np.zeros(size)
                if own.all():
                    start[-1] = np.log(own[1] / own[0])
                    searches.append(Search(f, penalty, own.sum(), inverse(curvature + np.diag(penalty)), start))
                else:  # one class only, as LogisticRegression has it
                    start[-1] = np.inf if own[1] else -np.inf
                    searches.append(Search(f, penalty, own.sum(), np.eye(size), start, done=True))
        while moving := [s for s in searches if not s.done]:
            losses, slopes = _slopes(rows, np.stack([s.trial for s in moving]), np.array([s.fold for s in moving]))
            for s, loss, slope in zip(moving, losses, slopes):
                s.take(loss, slope, max_iter)
        points = np.stack([s.at for s in searches])
        return points, _hits(rows, points, np.array([s.fold for s in searches])).collect()
    finally:
        rows.unpersist()
