import pytest

from cohortlens.operators import evaluate

# Labels, predictions and scores with known metrics.
Y_TRUE = [0, 0, 1, 1, 0, 1, 0, 1, 1, 0]
Y_PRED = [0, 1, 1, 1, 0, 0, 0, 1, 1, 0]
Y_PROBA = [0.2, 0.6, 0.8, 0.9, 0.3, 0.4, 0.1, 0.7, 0.85, 0.15]


@pytest.fixture
def scored(frame):
    return frame("y int, p int, s double", *zip(Y_TRUE, Y_PRED, Y_PROBA))


def repeated(frame, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return frame("y int, p int", *rows)


def test_known_values(scored):
    r = evaluate.evaluation(scored, "y", "p", "s", "m").head()
    assert (r["true_negatives"], r["false_positives"], r["false_negatives"], r["true_positives"]) == (4, 1, 1, 4)
    assert r["f1_score"] == pytest.approx(0.8) and r["auc_roc"] == pytest.approx(0.96) and r["n_test_samples"] == 10


def test_published_matrix(frame):
    r = evaluate.binary_metrics(repeated(frame, 43, 10, 10, 207), "y", "p").head()
    assert round(r["accuracy"], 4) == 0.9259
    assert {round(r[c], 4) for c in ("precision", "recall", "f1_score")} == {0.9539}


def test_perfect_and_all_wrong(frame):
    good = evaluate.binary_metrics(repeated(frame, 5, 0, 0, 5), "y", "p").head()
    bad = evaluate.binary_metrics(repeated(frame, 0, 5, 5, 0), "y", "p").head()
    assert all(good[c] == 1.0 for c in ("accuracy", "precision", "recall", "f1_score"))
    assert all(bad[c] == 0.0 for c in ("accuracy", "precision", "recall", "f1_score"))


def test_no_positive_prediction(frame):
    r = evaluate.binary_metrics(repeated(frame, 3, 0, 2, 0), "y", "p").head()
    assert r["precision"] == 0.0 and r["f1_score"] == 0.0


def test_auc_counts_pairs(frame):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9), (1, 0.2)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(frame("y int, s double", *rows), "y", "s").head()[0] == pytest.approx(want)


def test_auc_of_one_class_is_null(frame):
    assert evaluate.roc_auc(frame("y int, s double", (1, 0.1), (1, 0.2)), "y", "s").head()[0] is None


def test_curves(scored):
    roc = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_curve(scored, "y", "s").collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0) and len(roc) == 11
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    assert area == pytest.approx(0.96)
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluate.pr_curve(scored, "y", "s").collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.9] == (1.0, 0.2) and pr[0.1] == (0.5, 1.0)


def test_matrix_forms(scored):
    assert sum(r["n"] for r in evaluate.confusion_long(scored, "y", "p").collect()) == 10
    rows = evaluate.confusion_normalized(scored, "y", "p").collect()
    assert {(r["actual"], r["predicted"]): r["share"] for r in rows} == {(0, 0): 0.8, (0, 1): 0.2, (1, 0): 0.2, (1, 1): 0.8}
    assert evaluate.matrix_array(evaluate.confusion(scored, "y", "p")).head()["matrix"] == [[4, 1], [1, 4]]


def test_report(scored):
    report = evaluate.classification_report(scored, "y", "p")
    rows = {r["class"]: r for r in report.collect()}
    assert set(rows) == {"Sem Risco (0)", "Em Risco (1)", "accuracy", "macro avg", "weighted avg"}
    assert rows["Em Risco (1)"]["support"] == 5 and rows["accuracy"]["f1_score"] == pytest.approx(0.8)
    text = evaluate.report_text(report)
    assert "Sem Risco (0)" in text and "weighted avg" in text and "0.80" in text


def test_cv_summary(frame):
    scores = frame("model string, score double, seconds double", ("a", 0.5, 1.0), ("a", 0.7, 2.0), ("b", 0.9, 1.0), ("b", 0.9, 1.0))
    rows = evaluate.cv_summary(scores, seconds="seconds").collect()
    assert [r["model"] for r in rows] == ["b", "a"]
    assert rows[1]["mean_score"] == pytest.approx(0.6) and rows[1]["std_score"] == pytest.approx(0.1)
    assert rows[1]["time_seconds"] == 3.0
    assert evaluate.best_model(evaluate.cv_summary(scores)).head()["model"] == "b"
