"""Operator 1, language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One linear classifier per bit, over hashed byte n-grams of the whole text,
predicts that bit. Decoding compares the margins with every codeword by a weighted loss; a bit weighs as much for a
language as the classifier was right on that language when the row was left out. The nearest codeword wins, and a
text whose two nearest codewords are about as near is flagged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import text_blocks
from cohortlens.session import materialize

UNKNOWN = "und"

_BUCKETS = 4_096
_COMPARED = 1_000  # languages up to which the best of several codes is taken
_CELLS = 1 << 24  # losses that are held at once
_BLOCK = 1 << 22
_LETTER = regex.compile(r"\p{L}")
# bytes that are no letters in ASCII are one and the same sign
_SIGN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed byte 1-, 2- and 3-grams of a text, whatever its length."""
    counts = np.zeros(_BUCKETS, np.int64)
    data = text.lower().encode("utf-8", "replace").translate(_SIGN)
    for begin in range(0, len(data), _BLOCK):
        part = np.frombuffer(data[max(0, begin - 2):begin + _BLOCK], np.uint8).astype(np.uint64)
        own = min(begin, 2)  # bytes of the block before, there for the longer n-grams
        code = np.zeros(len(part), np.uint64)
        for n in (1, 2, 3):
            code = (code[:len(part) - n + 1] << np.uint64(8)) | part[n - 1:]
            grams = code[max(0, own - n + 1):]
            hashed = (grams + np.uint64(n << 24)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
            counts += np.bincount(hashed.astype(np.int64), minlength=_BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each language: every division into two for up to seven, else the best of random codes."""
    if languages <= 7:
        bits = np.arange(1, 1 << max(languages - 1, 0))
        rows = np.vstack([np.zeros(len(bits), np.int64), (bits >> np.arange(languages - 1)[:, None]) & 1])
        return np.where(rows == 1, -1, 1)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(15 * np.log2(languages)))
    if languages > _COMPARED:  # random words of this length are far apart; comparing all pairs would cost more than it gives
        return rng.choice([-1, 1], (languages, length))
    best, best_distance = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (languages, length))
        near = code @ code.T - 3 * length * np.eye(languages, dtype=np.int64)
        distance = (length - near.max()) // 2
        if distance > best_distance and (abs(code.sum(0)) < languages).all():
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    """Languages, their codewords, the bit classifiers, the weight of each bit for each language, the sharpness."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row of margins from each codeword."""
        step = max(1, _CELLS // max(self.code.size, 1))
        out = np.zeros((len(margins), len(self.code)))
        for k in range(0, len(margins), step):
            loss = np.logaddexp(0, -2 * margins[k:k + step, None, :] * self.code[None])
            out[k:k + step] = (loss * self.trust[None]).sum(2)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        d = -self.sharpness * self.distances(margins)
        p = np.exp(d - d.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and what each row's prediction would be without it, by the smaller one of the two equal systems."""
    if len(x) <= x.shape[1]:
        inverse = np.linalg.inv(x @ x.T + penalty * np.eye(len(x)))
        alpha = inverse @ y
        return x.T @ alpha, y - alpha / np.diag(inverse)[:, None]
    inverse = np.linalg.inv(x.T @ x + penalty * np.eye(x.shape[1]))
    weights = inverse @ (x.T @ y)
    influence = np.einsum("ij,ij->i", x @ inverse, x)
    return weights, y - (y - x @ weights) / (1 - influence)[:, None]


def train(profiles: np.ndarray, names: list[str], ridge: float = 0.01) -> Model:
    """Regularised least squares for each bit, with exact leave-one-out margins for trust and sharpness."""
    languages = sorted(set(names))
    label = np.searchsorted(np.array(languages), np.array(names))
    code = codewords(len(languages))
    centre = profiles.mean(0)
    x = (profiles - centre).astype(np.float64)
    size = len(names)
    # rows weigh alike for each language, whatever its number of rows
    target = code[label].astype(np.float64)
    offset = target.mean(0)
    weights, left_out = _ridge(x, target - offset, ridge * max((x * x).sum() / size, 1e-9))
    left_out += offset
    right = (np.sign(left_out) == target).astype(np.float64)
    trust = np.vstack([right[label == k].mean(0) for k in range(len(languages))])
    trust = np.maximum(2 * trust - 1, 1e-3)
    trust /= np.maximum(trust.sum(1, keepdims=True), 1e-9)
    model = Model(languages, code, weights.astype(np.float32), (offset - centre @ weights).astype(np.float32), trust, 1.0)

    def surprise(sharpness: float) -> float:
        model.sharpness = sharpness
        return -np.log(np.maximum(model.probabilities(left_out)[np.arange(size), label], 1e-12)).mean()

    model.sharpness = min((1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=surprise)
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = 1_600) -> Model | None:
    """The classifiers, from at most `fit_rows` distinct labelled texts shared evenly by the languages, one of each at least.

    Every language gives its whole share, or all its texts if it has fewer. Rows without text or language are left out;
    equal texts of a language count once; texts are read whole. None if no row is left. The driver holds a count and a codeword per
    language, and with more than `fit_rows` languages one text of each, so the model grows with the number of languages only.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("lang", "text"))
    hashes = materialize(rows.select("lang", "h").distinct(), "language-hashes")
    sizes = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}
    if not sizes:
        return None
    quota = max(fit_rows // len(sizes), 1)
    wanted = _least_hashes(hashes, sizes, quota)
    wanted = labelled.sparkSession.createDataFrame([(h,) for h in wanted], "h bigint")
    chosen = rows.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"]).select("lang", "h", "text")

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1 << 20):
            made = [profile(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(made, pa.binary())], names=["lang", "h", "profile"])

    kept = sorted(chosen.mapInArrow(profiles, "lang string, h bigint, profile binary").collect(), key=lambda r: (r["lang"], r["h"]))
    return train(np.vstack([np.frombuffer(r["profile"], np.float32) for r in kept]), [r["lang"] for r in kept])


def _least_hashes(hashes: DataFrame, sizes: dict[str, int], quota: int) -> list[int]:
    """The `quota` least hashes of every language (all if it has fewer), from distinct (lang, h) rows.

    Only hashes below a bound for each language are collected: several times the square root of the quota more than
    it on average. A language that falls short all the same gets a higher bound.
    """
    found, expected = {}, quota + 8 * math.isqrt(quota) + 16
    open_ = dict(sizes)
    while open_:
        share = hashes.sparkSession.createDataFrame([(lang, int(min(1.0, expected / n) * (1 << 30))) for lang, n in open_.items()], "lang string, bound bigint")
        place = F.pmod("h", F.lit(1 << 30))
        gathered = defaultdict(list)
        # one row per language
        below = hashes.join(F.broadcast(share), "lang").where(place < F.col("bound"))
        for r in below.select("lang", place.alias("place"), "h").collect():
            gathered[r["lang"]].append((r["place"], r["h"]))
        found.update({lang: sorted(g)[:quota] for lang, g in gathered.items()})
        open_ = {lang: n for lang, n in open_.items() if len(found.get(lang, ())) < min(quota, n)}
        expected *= 4
    return [h for own in found.values() for _, h in own]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguity: float = 0.2) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), runner_up, ambiguous.

    A text that is null or has no letter is `und` with score 0; without a model every text is. `ambiguous` is true if
    the score is less than `ambiguity` above the runner-up's. Of languages with the same score the first by name wins. Texts are
    read whole, in blocks if they are very long. Ids are only passed through, so null and repeated ids and repeated rows keep
    their rows; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if model and t and _LETTER.search(t)]
            lang, score, other = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for begin in range(0, len(known), 256):
                part = known[begin:begin + 256]
                margins = np.vstack([profile(texts[k]) for k in part]) @ model.weights + model.bias
                p = model.probabilities(margins.astype(np.float64))
                order = np.argsort(-p, 1, kind="stable")
                for k, row, places in zip(part, p, order):
                    lang[k], score[k] = model.languages[places[0]], float(row[places[0]])
                    if len(places) > 1:
                        other[k] = model.languages[places[1]]
                        gap = row[places[0]] - row[places[1]]
                        texts[k] = gap < ambiguity
                    else:
                        texts[k] = False
            unsure = [t if isinstance(t, (bool, np.bool_)) else True for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(other, pa.string()), pa.array(map(bool, unsure), pa.bool_())],
                names=["id", "lang_pred", "score", "runner_up", "ambiguous"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, runner_up string, ambiguous boolean").withColumnRenamed("id", id_col)
