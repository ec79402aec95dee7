import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, panel
from cohortlens.sources import synthetic
from cohortlens.spec import Feature, PanelSpec


def engineered(df, key="k"):
    return features.engineer(df, PanelSpec.from_schema(df.schema, key))


def test_temporal(frame):
    df = frame("k int, INDE_2020 double, INDE_2021 double, INDE_2022 double", (1, 5.0, 6.0, 7.0))
    r = engineered(df).head()
    assert (r["INDE_diff_2020_2021"], r["INDE_diff_2021_2022"]) == (1.0, 1.0)
    assert (r["INDE_trend"], r["INDE_mean"], r["INDE_std"]) == (2.0, 6.0, 1.0)


def test_gap_is_bridged(frame):
    r = engineered(frame("k int, IAA_2020 double, IAA_2022 double", (1, 5.0, 8.0))).head()
    assert r["IAA_diff_2020_2022"] == 3.0


def test_null_years(frame):
    df = frame("k int, INDE_2020 double, INDE_2021 double", (1, None, 6.0))
    r = engineered(df).head()
    assert r["INDE_diff_2020_2021"] is None and r["INDE_trend"] is None
    assert r["INDE_mean"] == 6.0 and r["INDE_std"] == 0.0


def test_single_year_is_skipped(frame):
    assert not any("diff" in c or "trend" in c for c in engineered(frame("k int, INDE_2022 double", (1, 7.0))).columns)


def test_text_indicator_has_no_temporal_features(frame):
    df = frame("k int, INDE_2021 string, INDE_2022 string", (1, "7", "8"))
    out = engineered(df)
    assert "INDE_trend" not in out.columns and out.head()["RISK_SCORE"] == 2.0


def test_composites(frame):
    df = frame("k int, INDE_2022 double, IAA_2022 double, IDA_2022 double, IEG_2022 double, IPS_2022 double", (1, 7.0, 6.0, 8.0, 7.0, 5.0))
    r = engineered(df).head()
    assert r["ACADEMIC_COMPOSITE"] == 7.0 and r["ENGAGEMENT_COMPOSITE"] == 6.0
    risk = engineered(frame("k int, INDE_2022 double, IEG_2022 double, IPS_2022 double", (1, 8.0, 7.0, 6.0))).head()
    assert risk["RISK_SCORE"] == 3.0


def test_progress_and_gap(frame):
    df = frame("k int, PONTO_VIRADA_2022 int, ANOS_PM_2022 int, IDADE_ALUNO_2022 int, FASE_2022 int", (1, 1, 3, 14, 4))
    r = engineered(df).head()
    assert r["PROGRESS_INDEX"] == 3.0 and r["AGE_PHASE_GAP"] == 4.0


def test_interactions(frame):
    df = frame("k int, INDE_2022 double, IEG_2022 double, IPS_2022 double, IAA_2022 double, BOLSISTA_2022 int", (1, 7.0, 6.0, 5.0, 8.0, None))
    r = engineered(df).head()
    assert (r["INDE_IEG_INTERACTION"], r["IPS_IAA_INTERACTION"], r["BOLSISTA_INDE_INTERACTION"]) == (42.0, 40.0, 0.0)


def test_one_projection_and_no_python(spark):
    df = synthetic.generate(spark, 50)
    out = engineered(df, "row_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert len(out.columns) > len(df.columns) + 40


def test_no_nulls_in_null_safe_features(spark):
    out = engineered(synthetic.generate(spark, 100), "row_id")
    safe = [c for c in out.columns if c.endswith(("_std", "_INTERACTION"))]
    assert out.select([F.count_if(F.col(c).isNull()).alias(c) for c in safe]).head().asDict() == dict.fromkeys(safe, 0)


def test_custom_feature(frame):
    df = frame("a double, b double", (2.0, 3.0))
    r = features.build(df, [Feature("c", "linear", ("a", "b"), (2.0, 1.0, -1.0))]).head()
    assert r["c"] == 6.0
    with pytest.raises(ValueError):
        features.build(df, [Feature("c", "nope", ("a",))])


def test_wide_long_round_trip(spark):
    df = synthetic.generate(spark, 40, null_rate=0.0)
    spec = PanelSpec.from_schema(df.schema, "row_id")
    stems = ["INDE", "IAA", "PEDRA"]
    long = panel.to_long(df, spec, stems)
    assert long.count() == 120
    back = panel.to_wide(long, "row_id", "year", spec.years, stems)
    assert back.exceptAll(df.select(back.columns)).count() == 0


def test_long_windows_match_wide_features(spark):
    df = synthetic.generate(spark, 30, null_rate=0.0)
    spec = PanelSpec.from_schema(df.schema, "row_id")
    wide = features.engineer(df, spec)
    long = panel.to_long(df, spec, ["INDE"])
    trend = panel.entity_trend(long, "row_id", "year", ["INDE"]).withColumnRenamed("INDE_trend", "t")
    moments = panel.entity_moments(long, "row_id", ["INDE"]).select("row_id", F.col("INDE_mean").alias("m"), F.col("INDE_std").alias("s"))
    both = wide.join(trend, "row_id").join(moments, "row_id")
    assert both.where("abs(INDE_trend - t) > 1e-9 or abs(INDE_mean - m) > 1e-9 or abs(INDE_std - s) > 1e-9").count() == 0


def test_melt_keeps_nulls(frame):
    df = frame("k int, A_2021 double, A_2022 double", (1, None, 2.0))
    spec = PanelSpec.from_schema(df.schema, "k")
    assert sorted((r["year"], r["value"]) for r in panel.melt_years(df, spec, ["A"]).collect()) == [(2021, None), (2022, 2.0)]


def test_own_expressions(frame):
    df = frame("a double, b string", (4.0, "9"), (None, "1"), (2.0, "x"))
    own = Feature("ratio", "expression", ("a", "b"), ("sqrt({0}) / greatest({1}, 3)",))
    assert [r["ratio"] for r in features.build(df, [own]).collect()] == [2 / 9, None, pytest.approx(2 ** 0.5 / 3)]
