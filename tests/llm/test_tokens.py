import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from cohortlens.llm import bpe, token_counts as C, tokenizer as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'strevml  ab.,!?09½²é́‍😀_<|>", "<|endoftext|>", "  ", "'re", " 's", "中文", "᠎"]


def random_texts(n, length, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return T.library(PATH)


def test_ids_are_those_of_the_library(library):
    texts = random_texts(3000, 50) + ["a" * 999, " " * 300, "aaaa" * 7 + " aaaaa", "", "<|endoftext|>", "=" * 333]
    codec = bpe.codec(PATH)
    ids = codec.encode(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in ids] == expected
    assert [codec.decode(i) for i in ids] == library.decode_batch(expected, skip_special_tokens=False)


def test_decoding_of_broken_bytes(library):
    ids = library.encode("中文😀 é").ids
    for cut in range(len(ids)):
        assert bpe.codec(PATH).decode(np.array(ids[cut:])) == library.decode(ids[cut:], skip_special_tokens=False)


def test_counts_are_those_of_the_library(library):
    texts = random_texts(2000, 60, seed=2)
    counter = C.Counter(PATH)
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_space_cuts_give_the_text_back():
    for text in random_texts(500, 40, seed=3):
        assert " ".join(T.space_cuts(text)) == text


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 50)])
def test_long_texts_are_spliced(spark, library, chunk, overlap):
    texts = random_texts(60, 900, seed=4) + ["x" * 700 + " y" * 50, "word " * 300, "<|endoftext|>" * 40, "a" + " " * 500 + "b", ""]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    got = {r.key: r.n_tokens for r in C.long_counts(rows, PATH, chunk, overlap, 4).collect()}
    expected = {str(k): len(e.ids) for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    assert got == expected


def test_no_splice_without_a_common_border():
    left = {"n_tokens": 9, "head": [0], "head_token": [0], "tail": [40, 44], "tail_token": [7, 8]}
    right = {"n_tokens": 5, "head": [41, 44], "head_token": [0, 2], "tail": [], "tail_token": []}
    assert C.splice(pd.DataFrame([left, right])) == 8 + 5 - 2
    assert C.splice(pd.DataFrame([left, {**right, "head": [41, 45]}])) is None


def test_messy_rows(messy, library):
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in messy.collect())
    n = [len(e.ids) for e in library.encode_batch([t[2] for t in texts], add_special_tokens=False)]
    counted = C.count_tokens(messy, PATH, limit=3, chunk_chars=1000, overlap=100)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect())
    assert got == sorted((a, b, len(t.encode()), k, k > 3) for (a, b, t), k in zip(texts, n))
    made = bpe.encode(messy, PATH, digests=True)
    for r in made.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert sorted(r.n_tokens for r in made.collect()) == sorted(n)
    back = bpe.decode(made.select("doc_id", "ids"), PATH).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in back)) == texts
    assert C.count_tokens(messy.limit(0), PATH).count() == 0 and bpe.encode(messy.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.read(public_tokenizers.path("word_bpe_49k.json"))
