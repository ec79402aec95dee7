import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import suffix_arrays

SCHEMA = "doc_id bigint, text string"
LENGTH = 40


def brute(docs, length=LENGTH):
    """Plain statement of the contract: id, bytes, removed, runs, digest, kept."""
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i:i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(docs, texts):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def found(df, **options):
    rows = suffix_arrays.deduplicate(df, length=LENGTH, **options).collect()
    return sorted(((r[0], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows), key=repr)


def corpus(seed):
    """Random texts, shared passages with different and with partly equal surroundings, edited copies, periodic runs."""
    rng = random.Random(seed)
    letters = "abcdé "

    def noise(n):
        return "".join(rng.choices(letters, k=n))

    passages = [noise(rng.randrange(30, 200)) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = [noise(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:] if rng.random() < 0.5 else p[:len(p) - cut], noise(rng.randrange(0, 60))]
        docs.append((k, "".join(parts)))
    for k in range(10):
        text = rng.choice(docs)[1]
        at = rng.randrange(len(text) + 1)
        docs.append((100 + k, text[:at] + rng.choice(["", "X", "éé"]) + text[at:]))
    return docs + [(200, "a" * 300), (201, "b" + "a" * 90), (202, "ab" * 100), (203, "abc" * 60 + noise(50))]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"modulus": 6}), (3, {"modulus": 100_000}), (4, {"group": 1}), (5, {"group": 1, "modulus": 8}), (6, {"modulus": 8})])
def test_equals_brute_force(spark, seed, options):
    docs = corpus(seed)
    assert found(spark.createDataFrame(docs, SCHEMA).repartition(5), **{"modulus": 12, **options}) == brute(docs)


def test_without_the_order_of_the_corpus_edges_stay(spark, monkeypatch):
    docs = corpus(7)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    monkeypatch.setattr(suffix_arrays, "_sorted_groups", lambda length: lambda batches: iter(()))
    assert sum(r[2] for r in found(df, modulus=12)) < sum(r[2] for r in brute(docs))


def test_nulls_copies_and_foreign_columns(spark):
    long = "the quick brown fox jumps over the lazy dog and goes on " * 1
    docs = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "short"), (4, "short"), (5, long[:45] + "#" + long[45:]), (6, "x" * 50_000), (7, "é" * 30)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", *[f"'own' AS {c}" for c in ("t", "s", "k1", "runs", "id", "n_bytes", "data", "sha", "kept")])
    assert found(df) == brute(docs)
    assert found(df, modulus=3) == brute(docs)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError):
        suffix_arrays.deduplicate(spark.createDataFrame([], SCHEMA), length=20)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(1)
    data = "".join(rng.choices("abcd", k=5_000)).encode()
    whole = suffix_arrays.triggers(data, 7)
    gaps = list(suffix_arrays._without_trigger(data, 100, 4_000, 60))
    monkeypatch.setattr(suffix_arrays, "_PIECE", 64)
    assert suffix_arrays.triggers(data, 7).tolist() == whole.tolist()
    pieces = list(suffix_arrays._without_trigger(data, 100, 4_000, 60))
    assert {(b, a) for b, _, a, _ in gaps} <= {(b, a) for b, _, a, _ in pieces} and pieces[-1][1] == 4_000


def test_neighbours_in_the_order_of_the_corpus():
    content = [b"xyTRIG" + b"1" * 10, b"zyTRIG" + b"1" * 10, b"xyTRIG" + b"1" * 7 + b"222", b"xyTRIG" + b"1" * 10]
    places = suffix_arrays.repeated_places(["k", "k", "k", "other"], content, [2, 2, 2, 2], 10)
    # from the trigger 10 bytes agree in all three, with y before it 9, with xy 8 in the first and third
    assert [p.tolist() for p in places] == [[0, 1, 2], [0, 1], [0, 1, 2], []]
