import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def figures(rows):
    return sorted((r.id is None, r.id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in rows)


def test_metrics_of_random_texts(docs):
    rng = random.Random(5)
    signs = ["a", "b", "c ", " ", "\n", "\n\n", "\x0b", "#", "<|", "\xa0", "é", "a b c ", "\x1c", "\r"]
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    assert figures(Q.metrics(docs(*rows)).collect()) == sorted((False, k, *plain(t)) for k, t in rows)


def test_tail_is_the_exact_binomial_one(spark):
    cases = [(0, 30), (1, 200), (3, 400), (9, 1000), (40, 4100), (5, 5), (0, 0)]
    rows = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", Q.tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        exact = 1.0 if r.k >= r.n * 0.01 else sum(math.comb(r.n, i) * 0.01 ** i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def labelled(docs, n, broken_good=0, stratum="en"):
    """n good texts, some with many symbols, and as many bad ones that all have."""
    good = [(k, ("word%d " % k) * 60 + "$" * (200 if k < broken_good else 0), stratum) for k in range(n)]
    bad = [(n + k, "bad%d$$$ " % k * 60, stratum) for k in range(20)]
    return good, bad


RULES = (Q.Rule("symbols", "n_symbols / nullif(word_chars, 0)", (0.5, 0.3, 0.1)),)


def test_cutoffs_are_used_only_where_they_are_proven_safe(docs, spark):
    good, bad = labelled(docs, 300)
    few = [(1000 + k, "kurz " * 60, "de") for k in range(20)] + [(2000, "böse$$$ " * 60, "de")]
    rows = docs(*good, *bad, *few)
    labels = spark.createDataFrame([(k, 1) for k, *_ in good] + [(k, 0) for k, *_ in bad] + [(1000 + k, 1) for k in range(20)] + [(None, 1), (0, None), (0, 0)], "doc_id bigint, quality int")
    cuts = Q.thresholds(Q.metrics(rows), labels, rules=RULES).collect()
    assert [(r.stratum, r.cutoff, r.rejected, r.good) for r in cuts] == [("en", 0.1, 0, 300)]
    judged = Q.judge(rows, labels, max_repeat_percent=101, rules=RULES)
    dropped = {r.doc_id for r in judged.where("NOT kept").collect()}
    assert dropped == {k for k, *_ in bad}  # de has too few labels for any cutoff
    assert {tuple(r.broken) for r in judged.where("NOT kept").collect()} == {("symbols",)}


def test_a_cutoff_that_rejects_good_texts_stops_the_sequence(docs, spark):
    good, bad = labelled(docs, 300, broken_good=30)
    rows = docs(*good, *bad)
    labels = spark.createDataFrame([(k, 1) for k, *_ in good] + [(k, 0) for k, *_ in bad], "doc_id bigint, quality int")
    assert [r.cutoff for r in Q.thresholds(Q.metrics(rows), labels, rules=RULES).collect()] == [0.5]
    level = Q.thresholds(Q.metrics(rows), labels, rules=RULES, delta=1e-9)
    assert level.count() == 0


def test_messy_rows(messy, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    judged = Q.judge(messy, none, min_words=2)
    assert judged.count() == messy.count()
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in judged.collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == got[(4, 1)] == (True, False)
    assert got[(None, 3)] == (False, True) and got[(8, 30000)] == (True, False)
    assert figures(Q.metrics(messy).collect()) == sorted((r.doc_id is None, r.doc_id or 0, *plain(r.text)) for r in messy.collect())
    assert Q.judge(messy.limit(0), none).count() == 0
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().executedPlan().toString())
