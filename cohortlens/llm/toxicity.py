"""Operator 4, toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; everything else is a mixture of clean and toxic texts in which the toxic
share is the class prior. With the losses l+ and l- of calling a text toxic or clean, the risk is

    prior * mean_P(l+) + max(0, mean_U(l-) - prior * mean_P(l-))

The second part estimates the risk on clean texts and cannot be negative; when it is, training steps back from it.
The model is a linear one over the words of a text and their beginnings: whether they occur at least 1, 2, 4, ... times
and whether they make up at least so many thousandths of the words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import bounded_sample, text_blocks, texts_of
from cohortlens.session import materialize

_WORD = re.compile(r"\w+")
_STEMS = (4, 5, 6)
_TIMES = (1, 2, 4, 8, 16)
_THOUSANDTHS = (2, 4, 8, 16, 32)
_REMEMBERED = 100_000


def stems_of(word: str) -> list[str]:
    """A word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) >= n)]


def levels(stem: str, times: int, words: int) -> list[str]:
    """The features of a stem that occurs so many times among so many words."""
    share = 1000 * times
    return [f"{stem} {n}" for n in _TIMES if times >= n] + [f"{stem} /{n}" for n in _THOUSANDTHS if share >= n * words]


def features_of(text: str) -> set[str]:
    """All features of the whole text."""
    words = Counter(_WORD.findall(text.lower()))
    total, stems = words.total(), Counter()
    for word, n in words.items():
        for stem in stems_of(word):
            stems[stem] += n
    return {f for stem, n in stems.items() for f in levels(stem, n, total)}


@dataclass
class Model:
    """Number and weight of each chosen feature; the bias; the class prior it was trained with."""

    number: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self):
        self.stems = {f.rpartition(" ")[0] for f in self.number}
        self.seen: dict[str, tuple[str, ...]] = {}

    def active(self, text: str) -> list[int]:
        """Numbers of the features that the text has, ascending."""
        words = _WORD.findall(text.lower())
        stems: Counter[str] = Counter()
        for word in words:
            found = self.seen.get(word)
            if found is None:
                found = tuple(stem for stem in stems_of(word) if stem in self.stems)
                if len(self.seen) < _REMEMBERED and len(word) < 40:
                    self.seen[word] = found
            for stem in found:
                stems[stem] += 1
        return sorted(self.number[f] for stem, n in stems.items() for f in levels(stem, n, len(words)) if f in self.number)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.active(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[list[int]], positive: np.ndarray, n_features: int, prior: float,
          steps: int = 400, rate: float = 0.05, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (logistic loss, Adam on all rows)."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    columns = np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(rows)), sizes)
    is_p, is_u = positive, ~positive
    n_p, n_u = max(int(is_p.sum()), 1), max(int(is_u.sum()), 1)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[columns], minlength=len(rows)) + b
        p = _sigmoid(z)
        loss_clean = np.logaddexp(0, z)
        clean_risk = loss_clean[is_u].sum() / n_u - prior * loss_clean[is_p].sum() / n_p
        slope_clean = np.where(is_u, p / n_u, -prior * p / n_p)
        slope = -slope_clean if clean_risk < 0 else slope_clean + np.where(is_p, prior * (p - 1) / n_p, 0.0)
        gradient = np.append(np.bincount(columns, weights=slope[owner], minlength=n_features) + l2 * w, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {True: Counter(), False: Counter()}

    def made():
        names = list(counts[True].keys() | counts[False].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[True][n] for n in names], pa.int64()), pa.array([counts[False][n] for n in names], pa.int64())],
            names=["feature", "p", "u"])
        counts[True].clear(), counts[False].clear()
        return out

    for batch in text_blocks(batches, "text", 1 << 20):
        for text, positive in zip(texts_of(batch, "text"), batch.column("positive").to_pylist()):
            counts[positive].update(features_of(text))
        if len(counts[False]) + len(counts[True]) > 60_000:
            yield made()
    yield made()


def fit(positives: DataFrame, unlabelled: DataFrame, prior: float, text_col: str = "text",
        max_positives: int = 4_000, max_unlabelled: int = 8_000, max_features: int = 4_096, min_support: int = 8) -> Model | None:
    """Learn from confirmed toxic texts and unlabelled ones with the given share of toxic texts among the latter.

    At most about `max_positives` and `max_unlabelled` distinct texts are used, chosen by hash. Null texts are left out.
    None if there is no positive or no unlabelled text, or if `prior` is not between 0 and 1.
    """
    parts = []
    for rows, most, positive in ((positives, max_positives, True), (unlabelled, max_unlabelled, False)):
        texts = rows.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
        parts.append(bounded_sample(texts, ["text"], most).select("text", F.lit(positive).alias("positive")))
    sample = materialize(parts[0].unionByName(parts[1]), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2 or not 0 < prior < 1:
        return None
    # features that are more frequent among the positives, by how surely they are
    n_p, n_u = float(sizes[True]), float(sizes[False])
    total = (F.col("p") + F.col("u")) / (n_p + n_u)
    surer = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(total * (1 - total + 1e-9) * (1 / n_p + 1 / n_u))
    support = sample.mapInArrow(_support, "feature string, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    chosen = support.where(F.col("p") >= min_support).select("feature", surer.alias("z")).where("z > 3").orderBy(F.desc("z"), "feature").limit(max_features).collect()
    model = Model({r["feature"]: k for k, r in enumerate(chosen)}, np.zeros(len(chosen)), 0.0, prior)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.active(t) for t in texts_of(batch, "text")], pa.list_(pa.int32())), batch.column("positive")], names=["active", "positive"])

    rows = sorted((r["positive"], r["active"]) for r in sample.mapInArrow(active, "active array<int>, positive boolean").collect())
    model.weights, model.bias = train([r[1] for r in rows], np.array([r[0] for r in rows]), len(chosen), prior)
    return model


def fit_from_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_positives: int = 4_000, max_unlabelled: int = 8_000) -> Model | None:
    """`fit` with the documents that `labels` confirms as toxic, all documents as unlabelled, and the labelled share as prior.

    A document is confirmed if any of its labels is 1. Labels without id or value are left out. The hashes of the
    positives' distinct texts are broadcast: about `max_positives` at most.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic or toxic == total:
        return None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = rows.where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    confirmed = materialize(hashed.select("id", "h").join(known.where("toxic = 1").select("id"), "id").select("h").distinct(), "toxicity-confirmed")
    wanted = bounded_sample(confirmed, ["h"], max_positives).select("h")
    positives = materialize(hashed.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"]).select("text"), "toxicity-positives")
    return fit(positives, rows, toxic / total, "text", max_positives, max_unlabelled)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if the score is at least 0.5).

    A null text counts as empty and gets the score of a text without any known word; without a model every score is 0.
    Ids are only passed through, so null and repeated ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            scores = [model.score(t) if model else 0.0 for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text `score` would not predict as toxic; all rows without a model."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text_col, 4 << 20):
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in texts_of(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
