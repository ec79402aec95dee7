import math
import random

import numpy as np
import pytest

from cohortlens.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100):
    """Plain statement of the contract over (id, vector, label)."""
    live = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        live.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (anchor, v, label) in enumerate(live):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), other, lab, k) for k, (other, w, lab) in enumerate(live)]
        near = sorted((s for s in scored if s[2] == label and s[3] != a), key=key)[:5]
        for p, positive, _, _ in near:
            far = sorted((s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=key)[:5]
            out.extend((anchor, positive, r, s[1], p, s[0]) for r, s in enumerate(far, 1))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_equals_brute_force(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], rng.randrange(4)) for i in range(600)]
    rows += [(i + 600, [x + rng.gauss(0, 0.1) for x in rows[i][1]], rng.randrange(4)) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(hard_negatives.mine(df, every=20, block=16).collect()) == ordered(brute(rows, 20))


def test_nulls_ties_copies_and_foreign_columns(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.9, 0.0], 2), (2, [0.9, 0.0], 2),
            (3, [0.9, 0.0], 2), (4, [float("nan"), 1.0], 2), (5, [float("inf"), 1.0], 2), (6, [None, 1.0], 1), (7, None, 1), (8, [1.0, 0.0], None),
            (9, [-1.0, 0.0], 3), (100, [0.0, 0.0], 3), (200, [0.0, 0.0], 4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS uid", "'own' AS id", "'own' AS vector", "'own' AS score", "'own' AS anchor")
    assert ordered(hard_negatives.mine(df).collect()) == ordered(brute(rows))


def test_empty_table_unequal_and_too_large_vectors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], SCHEMA)).collect() == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], SCHEMA))
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e15], 1), (1, [1e15], 1)], SCHEMA))


@pytest.mark.parametrize("codes", [1, 2, 5])
def test_intervals_are_certain_and_narrow(codes):
    rng = np.random.default_rng(codes)
    vectors = np.floor(256 * rng.standard_normal((400, 64))).astype(np.int64)
    turns = hard_negatives.rotations(64, codes, 1)
    bits, alignments, residual = hard_negatives.encode(vectors, turns)
    length = np.sqrt((vectors.astype(float) ** 2).sum(1))
    queries = hard_negatives.Queries(np.arange(30), ["a"] * 30, vectors[:30], turns)
    lower, upper = queries.intervals(bits, alignments, residual, length)
    exact = vectors[:30] @ vectors.T
    assert ((lower <= exact) & (exact <= upper)).all()
    # each code keeps 2/pi of what is left
    assert np.median(residual / length) == pytest.approx((1 - 2 / np.pi) ** (codes / 2), rel=0.1)
