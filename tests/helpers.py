"""Constants that several test modules share."""

NOW = "2024-02-01 12:00:00"
# Small ensembles, so that unit tests fit in moments.
LIGHT = {
    "LogisticRegression": {"max_iter": 50}, "RandomForest": {"trees": 10, "depth": 5}, "GradientBoosting": {"trees": 5},
    "SVM": {"max_iter": 20}, "XGBoost": {"trees": 5, "depth": 3},
}
