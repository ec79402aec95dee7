"""Operator 13, hard-negative mining over rotated one-bit codes.

Vectors become integers, so that scores (inner products) are exact. Each vector is coded in `codes` steps. A step rotates
what is left of the vector by a fixed random rotation, keeps one bit per dimension (the sign) and the alignment of the
code with the vector, that is the length of the vector along the code, and passes on the residual. The stored form is the
bits, the alignments and the length of the last residual.

The score of a query with a coded vector is estimated from the alignments and from popcounts of the bits with the bit
planes of the rotated, quantised query. By Cauchy and Schwarz the estimate is off by no more than the residual's length
times the query's length across the last code, plus each alignment times the query's quantisation error; both are known, so the
interval is certain, not likely. A row whose interval cannot reach what is wanted is left out, the others are
scored in integers. Every result is therefore exact.

Anchors are taken in blocks of `block`. A block is carried to all rows, which stay where they are; a task returns
the best few rows for each anchor of the block. Positives come first, then, with their scores, the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.common import batch_of
from cohortlens.session import materialize, scratch_dir

_CHUNK = 2048  # rows that are compared with a block at once
_PAIRS = 1 << 16  # pairs that are scored at once
_SLACK = 1e-9  # share of the lengths that covers rounding of the estimate
_NO_ID = np.iinfo(np.int64).max

OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_CODED = "uid bigint, id bigint, label string, vector array<bigint>, bits array<bigint>, alignments array<double>, residual double, length double"
_HIT = {"anchor": pa.int64(), "slot": pa.int32(), "uid": pa.int64(), "id": pa.int64(), "score": pa.int64()}
_HIT_SQL = "anchor bigint, slot int, uid bigint, id bigint, score bigint"


def rotations(dims: int, codes: int, seed: int) -> list[np.ndarray]:
    """Matrices with orthonormal columns: the first from `dims` to a multiple of 64 dimensions, the others square."""
    wide = max(1, -(-dims // 64)) * 64
    random = np.random.default_rng(seed)
    out = [np.linalg.qr(random.standard_normal((wide, wide)))[0] for _ in range(codes)]
    return [out[0][:, :dims], *out[1:]]


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags, a multiple of 64 long, as words."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits (n, codes, words), alignments (n, codes) and residual lengths (n) of integer vectors."""
    rest = vectors.astype(np.float64)
    bits, alignments = [], []
    for turn in turns:
        rest = rest @ turn.T
        signs = rest >= 0
        alignment = np.abs(rest).sum(1) / np.sqrt(turn.shape[0])
        rest = rest - alignment[:, None] * np.where(signs, 1.0, -1.0) / np.sqrt(turn.shape[0])
        bits.append(_packed(signs))
        alignments.append(alignment)
    return np.stack(bits, 1), np.stack(alignments, 1), np.sqrt((rest * rest).sum(1))


@dataclass
class Queries:
    """Anchors with the bit planes of their rotated and quantised vectors."""

    uid: np.ndarray
    labels: list[str]
    vectors: np.ndarray
    turns: list[np.ndarray]
    planes: int = 8
    number: dict[str, int] = field(init=False)
    label: np.ndarray = field(init=False)
    steps: list[tuple] = field(init=False)
    length: np.ndarray = field(init=False)

    def __post_init__(self):
        self.number = {}
        self.label = np.array([self.number.setdefault(x, len(self.number)) for x in self.labels], np.int64)
        self.steps = []
        y = self.vectors.astype(np.float64)
        self.length = np.sqrt((y * y).sum(1))
        for turn in self.turns:
            y = y @ turn.T
            low = y.min(1)
            step = np.maximum(y.max(1) - low, 1e-300) / ((1 << self.planes) - 1)
            units = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
            off = y - (low[:, None] + step[:, None] * units)
            words = [_packed((units >> b) & 1 != 0) for b in range(self.planes)]
            self.steps.append((low, step, units.sum(1), words, np.sqrt((off * off).sum(1))))

    def intervals(self, bits: np.ndarray, alignments: np.ndarray, residual: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (anchors, rows) of the scores of coded rows."""
        wide = bits.shape[2] * 64
        estimate = np.zeros((len(self.uid), len(bits)))
        error = np.zeros_like(estimate)
        for k, (low, step, total, words, off) in enumerate(self.steps):
            code = bits[:, k]
            ones = np.bitwise_count(code).sum(1, dtype=np.int64)
            counted = np.zeros(estimate.shape, np.int64)
            for b, plane in enumerate(words):
                for w in range(plane.shape[1]):
                    counted += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int64) << b
            along = (low[:, None] * (2 * ones[None] - wide) + step[:, None] * (2 * counted - total[:, None])) / np.sqrt(wide)
            estimate += alignments[None, :, k] * along
            error += alignments[None, :, k] * off[:, None]
        # the last residual is square to its code, so only the part of the query that is square to it counts
        sure = np.maximum(np.abs(along) - off[:, None] - _SLACK * self.length[:, None], 0)
        across = np.sqrt(np.maximum(self.length[:, None] ** 2 - sure * sure, 0))
        error += across * residual[None] + _SLACK * self.length[:, None] * length[None]
        return estimate - error, estimate + error

    def scores(self, anchor: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (anchor, row)."""
        parts = [np.einsum("ij,ij->i", self.vectors[anchor[s:s + _PAIRS]], vectors[rows[s:s + _PAIRS]]) for s in range(0, len(anchor), _PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Best:
    """The best `keep` rows of each group; groups are numbered from 0."""

    def __init__(self, groups: int, keep: int):
        self.keep, self.rows = keep, np.zeros((0, 4), np.int64)
        self.least = np.full(groups, -np.inf)  # what a row must reach to count

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([group, score, ids, uid], 1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - first
        last = rows[rank == self.keep - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.rows = rows[rank < self.keep]


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dims)


def _coded_chunks(batches: Iterator[pa.RecordBatch], queries: Queries):
    """Arrays of uid, id, number of the label (-1 if no anchor has it), vector, bits, alignments, residual and length."""
    dims, turns, number = queries.vectors.shape[1], queries.turns, queries.number
    wide = turns[0].shape[0] // 64
    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            b = batch.slice(start, _CHUNK)
            yield (
                b.column("uid").to_numpy(), b.column("id").fill_null(_NO_ID).to_numpy(), np.array([number.get(x, -1) for x in b.column("label").to_pylist()], np.int64),
                _matrix(b.column("vector"), dims, np.int64), _matrix(b.column("bits"), len(turns) * wide, np.int64).view(np.uint64).reshape(-1, len(turns), wide),
                _matrix(b.column("alignments"), len(turns), np.float64), b.column("residual").to_numpy(), b.column("length").to_numpy())


def _hits(queries: Queries, best: _Best, slots: int) -> pa.RecordBatch:
    group, score, ids, uid = best.rows.T if len(best.rows) else np.zeros((4, 0), np.int64)
    known = pa.array(ids, pa.int64(), mask=ids == _NO_ID)
    return batch_of(_HIT, anchor=pa.array(queries.uid[group // slots], pa.int64()), slot=pa.array(group % slots, pa.int32()), uid=pa.array(uid, pa.int64()), id=known, score=pa.array(score, pa.int64()))


def _positives(queries: Queries, keep: int):
    """The best rows of the anchor's label, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.uid), keep)
        for uid, ids, label, vectors, *coded in _coded_chunks(batches, queries):
            lower, upper = queries.intervals(*coded)
            open_ = (queries.label[:, None] == label[None]) & (queries.uid[:, None] != uid[None])
            if len(uid) > keep:  # the keep-th best lower bound is reached by as many rows
                floor = -np.partition(-np.where(open_, lower, -np.inf), keep - 1, axis=1)[:, keep - 1]
                open_ &= upper >= np.maximum(best.least, floor)[:, None]
            anchor, rows = np.nonzero(open_ & (upper >= best.least[:, None]))
            best.add(anchor, queries.scores(anchor, rows, vectors), ids[rows], uid[rows])
        yield _hits(queries, best, 1)

    return run


def _negatives(queries: Queries, least: np.ndarray, most: np.ndarray, keep: int):
    """The best rows of other labels whose score lies between the bounds (anchors, slots) of a positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = least.shape[1]
        best = _Best(least.size, keep)
        for uid, ids, label, vectors, *coded in _coded_chunks(batches, queries):
            lower, upper = queries.intervals(*coded)
            other = queries.label[:, None] != label[None]
            wanted = best.least.reshape(least.shape)
            reach = np.zeros_like(other)
            for s in range(slots):
                reach |= (upper >= np.maximum(least[:, s], wanted[:, s])[:, None]) & (lower <= most[:, s, None])
            anchor, rows = np.nonzero(other & reach)
            score = queries.scores(anchor, rows, vectors)
            for s in range(slots):
                fits = (score >= least[anchor, s]) & (score <= most[anchor, s])
                best.add(anchor[fits] * slots + s, score[fits], ids[rows[fits]], uid[rows[fits]])
        yield _hits(queries, best, slots)

    return run


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], np.ascontiguousarray(rows).reshape(-1))


def _coder(dims: int, turns: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dims, np.int64)
            peak = int(np.abs(vectors.astype(np.float64)).max(initial=0))
            if peak * peak * max(dims, 1) >= 1 << 62:
                raise ValueError("components are too large for scores in 64 bits")
            bits, alignments, residual = encode(vectors, turns)
            length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "id", "label", "vector")),
                 _lists(bits.view(np.int64).reshape(len(vectors), -1)), _lists(alignments), pa.array(residual), pa.array(length)],
                names=["uid", "id", "label", "vector", "bits", "alignments", "residual", "length"])

    return run


def coded(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, codes: int, seed: int) -> tuple[DataFrame, int, list[np.ndarray]]:
    """The rows that take part, written with their codes; their dimensions and the rotations."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.where(F.col(label_col).isNotNull() & x.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("vector"))
    # row numbers hold for what is written
    kept = materialize(kept.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    least, most = kept.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most:
        raise ValueError("vectors differ in length")
    turns = rotations(most or 0, codes, seed)
    return materialize(kept.mapInArrow(_coder(most or 0, turns), _CODED), "negatives-codes"), most or 0, turns


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of `size`; the driver holds one list and one partition."""
    held = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _first(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, codes: int = 5, block: int = 512, seed: int = 7) -> DataFrame:
    """Hard negatives of the anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the inner product. Anchors are the rows whose id is divisible by
    `every`. An anchor's positives are its first `positives` other rows of its label, by score, then the smaller id. For
    each of them come the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score, rank from 1. Where there are fewer such rows there are fewer, none if there are none.

    Rows with a null label or vector, or with a null or non-finite component, take no part. A null id is no anchor and
    comes last among ties. Rows that repeat an id are rows of their own; an anchor is not its own positive, its copies
    are. Vectors of no dimension score 0. Vectors of different lengths and scores beyond 64 bits raise an error. An empty
    table gives an empty result; other columns are not read. The result is written to the shared folder.
    """
    spark = rows.sparkSession
    table, dims, turns = coded(rows, id_col, vector_col, label_col, scale, codes, seed)
    out = scratch_dir(spark, "negatives-found")
    spark.createDataFrame([], OUT).write.parquet(out)
    anchors = materialize(table.where(F.col("id") % every == 0).select("uid", "id", "label", "vector"), "negatives-anchors")
    for held in _blocks(anchors, block):
        uid = np.array([r["uid"] for r in held], np.int64)
        queries = Queries(uid, [r["label"] for r in held], np.array([r["vector"] for r in held], np.int64).reshape(len(held), dims), turns)
        near = _first(table.mapInArrow(_positives(queries, positives), _HIT_SQL), positives).collect()
        at = {u: k for k, u in enumerate(uid.tolist())}
        # a slot without a positive takes nothing
        shape, size = (len(held), positives), np.iinfo(np.int64)
        least, most = np.full(shape, size.max), np.full(shape, size.min)
        given = []
        for r in near:
            a, s = at[r["anchor"]], r["rank"] - 1
            least[a, s], most[a, s] = -(-low * r["score"] // 100), high * r["score"] // 100
            given.append((r["anchor"], s, held[a]["id"], r["id"], r["score"]))
        pairs = spark.createDataFrame(given, "anchor bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
        far = _first(table.mapInArrow(_negatives(queries, least, most, negatives), _HIT_SQL), negatives)
        far.join(pairs, ["anchor", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
    return spark.read.schema(OUT).parquet(out)
