import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import toxicity as X
from cohortlens.llm.common import bounded_sample, crc_mod

SF = "/root/testdata/sf0.01"


def test_risk_is_corrected_for_the_class_prior():
    rng = np.random.default_rng(2)
    toxic = rng.random(3000) < 0.2
    rows = [[0] * bool(t) + [1] * bool(rng.random() < 0.5) for t in toxic]
    positive = np.zeros(3000, bool)
    extra = [[0] + [1] * bool(rng.random() < 0.5) for _ in range(500)]
    w, b = X.train(rows + extra, np.append(positive, np.ones(500, bool)), 2, prior=0.2)
    p = 1 / (1 + np.exp(-(b + np.array([sum(w[k] for k in r) for r in rows]))))
    assert (p[toxic] > 0.5).all() and (p[~toxic] < 0.5).all() and abs(p.mean() - 0.2) < 0.1


def test_features_count_words_and_beginnings():
    found = X.features_of("Idiots idiots, ab")
    assert {"idiots 1", "idiots 2", "idio* 2", "idiots /32", "ab 1"} <= found and "idiots 4" not in found and "ab*" not in {f.split()[0] for f in found}


def test_model_and_training_agree_on_features():
    model = X.Model({"idio* 1": 0, "ab 2": 1, "other 1": 2}, np.zeros(3), 0.0, 0.1)
    for text in ("idiot", "ab ab", "Idiom, ab other", ""):
        assert model.active(text) == sorted(model.number[f] for f in X.features_of(text) if f in model.number)


def test_held_out_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id < 4000") for t in ("documents", "labels"))
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = X.fit_from_labels(docs.where(learn), labels.where(learn))
    held = X.score(docs.where(~learn), model).join(labels, "doc_id").toPandas()
    rank, toxic = held["score"].rank(), held["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9 and held["predicted"][~toxic].mean() < 0.03 and held["predicted"][toxic].mean() > 0.6


def test_messy_rows_and_no_label(messy):
    model = X.Model({"one 1": 0}, np.array([6.0]), -3.0, 0.1)
    rows = X.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id for r in rows if r.predicted} == {4}
    clean = X.keep_clean(messy, model)
    assert clean.columns == messy.columns and clean.count() == messy.count() - 2 and clean.where("doc_id = 4").count() == 0
    labels = messy.select("doc_id", F.lit(0).alias("toxic"))
    assert X.fit_from_labels(messy, labels) is None
    assert X.fit_from_labels(messy, labels.limit(0)) is None
    assert {r.score for r in X.score(messy, None).collect()} == {0.0} and X.keep_clean(messy, None).count() == messy.count()
    assert X.score(messy.limit(0), model).count() == 0


@pytest.mark.parametrize("prior", [0.0, 1.0])
def test_impossible_priors_give_no_model(messy, prior):
    assert X.fit(messy, messy, prior) is None


def test_copies_do_not_use_up_the_samples(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"copied text {k % 40}") for k in range(4_000)], "doc_id bigint, text string")
    assert bounded_sample(docs, ["text"], 100).count() == 40
    given = []
    monkeypatch.setattr(X, "fit", lambda positives, *rest: given.append((positives.distinct().count(), rest[1])))
    X.fit_from_labels(docs, docs.select("doc_id", (F.col("doc_id") % 40 < 20).cast("int").alias("toxic")), max_positives=30)
    assert given == [(20, 0.5)]


def plain_score(model, text):
    """The same model by its definition: every feature of the text by counting, one weight after the other."""
    import math
    import re

    words = re.findall(r"\w+", text.lower())
    z = model.bias
    for feature, k in model.number.items():
        stem, _, level = feature.rpartition(" ")
        times = sum(w.startswith(stem[:-1]) and len(w) >= len(stem) - 1 if stem.endswith("*") else w == stem for w in words)
        if times and (1000 * times >= int(level[1:]) * len(words) if level[0] == "/" else times >= int(level)):
            z += float(model.weights[k])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def test_scores_equal_a_plain_scorer(spark, messy):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit_from_labels(docs, labels)
    asked = docs.where("doc_id % 12 = 0 AND length(text) < 8000").select("doc_id", "text").unionByName(messy.select("doc_id", "text").where("doc_id < 7 AND doc_id <> 4"))
    texts = {}
    for r in asked.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    seen = 0
    for r in X.score(asked, model).collect():
        if len(texts[r.doc_id]) == 1:
            seen += 1
            assert r.score == pytest.approx(plain_score(model, texts[r.doc_id][0]), abs=1e-9) and r.predicted == (r.score >= 0.5)
    assert seen > 60 and len(model.number) > 3
