import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import substrings as S


def plain(texts, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {i + k for i in range(len(w) - window + 1) if counts[tuple(w[i:i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def result(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in rows)


@pytest.mark.parametrize("seed,window,phrase", [(1, 6, 3), (2, 6, 6), (3, 9, 1), (4, 35, 8)])
def test_removed_words_are_those_of_the_definition(docs, seed, window, phrase):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(12 * window)]
    texts = []
    for _ in range(50):
        a, b = rng.randrange(10 * window), rng.randrange(10 * window)
        texts.append("  ".join([rng.choice("pqr") for _ in range(rng.randrange(2 * window))] + base[a:a + rng.randrange(3 * window)] + ["é"] + base[b:b + rng.randrange(2 * window)]))
    texts += ["q " * (2 * window), "a\nb\tc", texts[3], texts[3]]
    got = S.deduplicate(docs(*enumerate(texts)), window=window, phrase=phrase).collect()
    expected = plain(texts, window)
    assert result(got) == sorted((False, k, *e) for k, e in enumerate(expected)) and sum(e[1] for e in expected) > 0
    short = S.deduplicate(docs(*enumerate(texts)), window=window, phrase=phrase, texts=False)
    assert short.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(r.kept_sha256 for r in short.collect()) == sorted(e[2] for e in expected)


def test_pieces_of_long_texts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 20)
    text = " ".join(f"w{k}" for k in range(100)) + "  " + "x" * 60
    found = [(first + i, tuple(words[i:i + 7])) for first, words in S.window_blocks(text, 7) for i in range(len(words) - 6)]
    words = text.encode().split()
    assert found == [(i, tuple(words[i:i + 7])) for i in range(len(words) - 6)]
    assert [w for block in S.word_blocks(text) for w in block] == words and list(S.window_blocks("a b", 7)) == []


def test_long_texts_in_pieces_give_the_same_result(docs, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcd") for _ in range(400)) for _ in range(6)]
    monkeypatch.setattr(S, "_PIECE", 64)
    rows = S.deduplicate(docs(*enumerate(texts)), window=5, phrase=2).collect()
    assert result(rows) == sorted((False, k, *e) for k, e in enumerate(plain(texts, 5)))


def test_run_hashes_and_least_values():
    codes = np.arange(1, 200, dtype=np.uint64) ** np.uint64(5)
    for length in (1, 2, 3, 8, 28, 35, 64):
        slow = [sum(int(c) * pow(S._FACTOR, j, 1 << 64) for j, c in enumerate(codes[i:i + length])) % (1 << 64) for i in range(len(codes) - length + 1)]
        assert S._runs(codes, length).tolist() == slow
        assert S._least(codes, length).tolist() == [min(codes[i:i + length]) for i in range(len(codes) - length + 1)]


def test_messy_rows(messy):
    rows = messy.collect()
    got = S.deduplicate(messy, window=3, phrase=2)
    assert result(got.collect()) == sorted((r.doc_id is None, r.doc_id or 0, *e) for r, e in zip(rows, plain([r.text for r in rows], 3)))
    assert S.deduplicate(messy.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.deduplicate(messy, window=3, phrase=4)
