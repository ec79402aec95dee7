import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortlens.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 1_000_000_000


def brute(docs, min_docs=3, top=200):
    """Plain statement of the contract over (id, text, lang, source)."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in seen[lang].items() if d >= min_docs]

        def shares(count):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + UNIT * (count[t] + 1) // size for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            far = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
            rows = {"pair": [(o, sum(far(p[s], p[o], t) for t in kept)) for o in sources if o != s],
                    "term": [(t, far(p[s], whole, t)) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]}
            for part, items in rows.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed, n=300, sources=9, words=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["w", "W", "é", "ß", "中", "Z"]) + "".join(rng.choices("abÄç", k=rng.randrange(4))) for _ in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(words)], k=rng.randrange(30))), rng.choice(["en", "de", None]),
             rng.choice([f"s{k}" for k in range(sources)] + ["s0"] * sources + [None])) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"tile": 2, "bucket": 3, "top": 4, "mergers": 2}, {"tile": 3, "top": 1}])
def test_equals_brute_force(spark, sizes):
    docs = corpus(len(sizes))
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert sorted(map(tuple, divergence.audit(df, **sizes).collect())) == brute(docs, top=sizes.get("top", 200))


def test_nulls_ties_long_texts_and_foreign_columns(spark):
    docs = [(1, None, None, None), (2, "", "", ""), (3, "a B c", "en", "x"), (3, "a B c", "en", "x"), (4, "b A", "en", "y"), (5, "A" * 100_000, "en", "y"),
            (6, "a b " * 40_000, "en", "z"), (7, "\x00\x1f a|b", "en", None), (8, "42 !", "xx", "only"), (9, "q", "yy", "one"), (10, "q", "yy", "two")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", *[f"'own' AS {c}" for c in ("term", "n", "total", "p", "tile", "value", "rank", "item", "part")])
    found = sorted(map(tuple, divergence.audit(df).collect()))
    assert found == brute(docs)
    assert ("yy", "one", "pair", "two", 0, 1) in found and not any(r[0] == "xx" for r in found)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("keep", [1, 3, 20])
def test_skyband_has_the_points_that_few_dominate(keep):
    rng = np.random.default_rng(keep)
    n, total, place = rng.integers(1, 12, 400), rng.integers(1, 12, 400), rng.permutation(400)
    dominates = (n[:, None] >= n) & (total[:, None] <= total) & (place[:, None] < place)
    wanted = np.flatnonzero(dominates.sum(0) < keep)
    assert sorted(divergence.skyband(n, total, place, keep, block=32).tolist()) == wanted.tolist()


def test_terms_of_a_long_text_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 5)
    pieces = list(divergence.term_pieces("Aaaa bbbbbbbb c  dd é1f"))
    assert len(pieces) > 2 and sum(pieces, []) == [b"aaaa", b"bbbbbbbb", b"c", b"dd", "é".encode(), b"f"]
