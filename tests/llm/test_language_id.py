import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import language_id as L
from cohortlens.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 9, 20])
def test_codewords_are_far_apart_and_split_the_languages(n):
    code = L.codewords(n)
    assert set(np.unique(code)) <= {-1, 1} and (abs(code.sum(0)) < n).all()
    distance = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert distance >= (1 if n == 2 else 2 if n == 3 else 4)


def test_decoding_corrects_a_wrong_bit():
    code = L.codewords(4)
    model = L.Model(list("abcd"), code, None, None, np.full(code.shape, 1 / code.shape[1]), 8.0)
    margins = code.astype(float).copy()
    margins[:, 0] *= -1
    assert model.probabilities(margins).argmax(1).tolist() == [0, 1, 2, 3]


def test_trust_follows_the_left_out_margins():
    rng = np.random.default_rng(1)
    centres = rng.random((3, 40))
    x = np.vstack([c + 0.02 * rng.random((30, 40)) for c in centres]).astype(np.float32)
    model = L.train(x, ["a"] * 30 + ["b"] * 30 + ["c"] * 30)
    p = model.probabilities((x @ model.weights + model.bias).astype(float))
    assert [model.languages[k] for k in p.argmax(1)] == ["a"] * 30 + ["b"] * 30 + ["c"] * 30
    assert np.allclose(model.trust.sum(1), 1)


def test_profile_of_a_long_text_does_not_depend_on_the_blocks(monkeypatch):
    text = "Ein längerer Text, 12 Mal; " * 40
    whole = L.profile(text)
    monkeypatch.setattr(L, "_BLOCK", 37)
    assert np.allclose(whole, L.profile(text))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2), fit_rows=400)
    found = L.predict(docs.where(crc_mod(F.col("doc_id"), 4) == 2), model).join(docs, "doc_id")
    right, n, low, high = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.97 and 0 <= low <= high <= 1


def test_messy_rows_and_no_model(messy):
    model = L.train(np.vstack([L.profile(t) for t in ("the and of", "der und das")]), ["en", "de"])
    rows = L.predict(messy, model).collect()
    assert len(rows) == messy.count() and sorted(L.predict(messy, model).columns) == ["ambiguous", "doc_id", "lang_pred", "runner_up", "score"]
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1, 2, 3))
    assert by_id[9].lang_pred in ("en", "de")
    assert {r.lang_pred for r in L.predict(messy, None).collect()} == {"und"}


def test_empty_and_unlabelled_tables(messy):
    assert L.fit(messy.limit(0)) is None
    assert L.fit(messy.withColumn("lang", F.lit(None).cast("string"))) is None
    assert L.predict(messy.limit(0), None).count() == 0
    one = L.fit(messy)
    assert one.languages == ["en"] and {r.lang_pred for r in L.predict(messy, one).collect()} == {"en", "und"}


def test_copies_do_not_use_up_the_share_of_a_language(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(L, "train", lambda profiles, names: learned.append((len(profiles), names)))
    rows = [(f"text number {k}", "many") for k in range(200)] + [(f"copied text {k % 3}", "few") for k in range(3_000)]
    L.fit(spark.createDataFrame(rows, "text string, lang string"), fit_rows=40)
    (size, names), = learned
    assert size == 23 and names == ["few"] * 3 + ["many"] * 20


def test_least_hashes_are_whole_when_the_first_bound_is_too_low(spark):
    rows = [("a", (k << 30) + (1 << 29) + k) for k in range(1_000)]  # none below the first bound
    found = L._least_hashes(spark.createDataFrame(rows, "lang string, h bigint"), {"a": 1_000}, 5)
    assert sorted(found) == [h for _, h in rows[:5]]


def plain_prediction(model, text):
    """The same model by its definition, with dictionaries and loops: n-grams, margins, losses, shares."""
    import math

    import regex

    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode("utf-8", "replace"))
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            gram = int.from_bytes(data[i:i + n], "big") + (n << 24)
            bucket = (gram * 0x9E3779B97F4A7C15 % (1 << 64)) >> 52
            counts[bucket] = counts.get(bucket, 0) + 1
    total = sum(counts.values())
    margins = [float(model.bias[b]) + sum(math.sqrt(c / total) * float(model.weights[k, b]) for k, c in counts.items()) for b in range(model.code.shape[1])]
    distance = [sum(float(model.trust[k, b]) * math.log1p(math.exp(-2 * m * int(model.code[k, b]))) for b, m in enumerate(margins)) for k in range(len(model.languages))]
    shares = [math.exp(-model.sharpness * (d - min(distance))) for d in distance]
    best = max(range(len(shares)), key=lambda k: shares[k])
    return model.languages[best], shares[best] / sum(shares)


def test_predictions_equal_a_plain_scorer(spark, messy):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0 AND length(text) < 6000")
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"), fit_rows=200)
    for table in (docs.select("doc_id", "text"), messy.select("doc_id", "text")):
        texts = {}
        for r in table.collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        for r in L.predict(table, model).collect():
            if len(texts[r.doc_id]) == 1:
                lang, score = plain_prediction(model, texts[r.doc_id][0])
                assert r.score == pytest.approx(score, abs=2e-4)
                assert r.lang_pred == lang or r.score < 0.51


def test_any_number_of_languages(spark, monkeypatch):
    """More languages than `fit_rows`, with codes that are not compared and the system of the features."""
    monkeypatch.setattr(L, "_COMPARED", 50)
    names = [f"l{k:04}" for k in range(1_050)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    said = {n: " ".join(letters[k % 26] + letters[k // 26 % 26] + letters[k // 676] + x for x in "xyz") for k, n in enumerate(names)}
    model = L.fit(spark.createDataFrame([(said[n], n) for n in names], "text string, lang string"), fit_rows=100)
    assert model.languages == names
    asked = spark.createDataFrame([(k, said[names[k]]) for k in range(0, 1_050, 70)], "doc_id bigint, text string")
    assert [r.lang_pred for r in L.predict(asked, model).orderBy("doc_id").collect()] == names[::70]


def test_both_systems_of_the_ridge_agree():
    rng = np.random.default_rng(4)
    for shape in ((30, 12), (12, 30)):
        x, y = rng.standard_normal(shape), rng.standard_normal((shape[0], 2))
        weights, left_out = L._ridge(x, y, 0.7)
        assert np.allclose(weights, np.linalg.solve(x.T @ x + 0.7 * np.eye(shape[1]), x.T @ y))
        for i in range(shape[0]):
            rest = np.arange(shape[0]) != i
            own = np.linalg.solve(x[rest].T @ x[rest] + 0.7 * np.eye(shape[1]), x[rest].T @ y[rest])
            assert np.allclose(left_out[i], x[i] @ own)
