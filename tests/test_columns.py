import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions.labels import class_name
from cohortlens.functions.numeric import named
from cohortlens.functions.text import number, ordinal_code, row_mean, row_std
from cohortlens.operators import columns, contract, encode, impute, panel, scale, target
from cohortlens.spec import PanelSpec, split_year


class TestNames:
    def test_year_suffix(self):
        assert split_year("INDE_2022") == ("INDE", 2022)
        assert split_year("2022") is None
        assert split_year("X_diff_2020_2021") is None
        assert split_year("X_1950") is None

    def test_latest_year(self, frame):
        spec = PanelSpec.from_schema(frame("k int, INDE_2020 double, INDE_2022 double, note string", (1, 1.0, 1.0, "")).schema, "k")
        assert spec.years == (2020, 2022) and spec.latest_year == 2022
        assert spec.numeric == ("k", "INDE_2020", "INDE_2022") and spec.text == ("note",)
        assert PanelSpec.from_json(spec.to_json()) == spec

    def test_no_year(self, frame):
        with pytest.raises(ValueError):
            PanelSpec.from_schema(frame("k int", (1,)).schema, "k").latest_year

    def test_year_columns(self):
        assert panel.year_columns(["A_2021", "A_2022", "A_diff_2021_2022", "B_2022"], 2022) == ["A_2022", "B_2022"]

    def test_identifiers(self, frame):
        df = frame("NOME string, ID int, MATRICULA string, aluno_id int, INDE_2022 double, IDADE_ALUNO_2022 int", ("a", 1, "m", 1, 7.5, 12))
        assert columns.drop_identifiers(df).columns == ["INDE_2022", "IDADE_ALUNO_2022"]
        assert columns.drop_identifiers(df, keep=("aluno_id",)).columns == ["aluno_id", "INDE_2022", "IDADE_ALUNO_2022"]

    def test_leakage_by_token_and_by_substring(self):
        names = ["IAN_2022", "NIVEL_IDEAL_2021", "MEDIANA_2022", "INDE_2022"]
        assert columns.leakage_columns(names) == names[:2]
        assert columns.leakage_columns(names, match="substring") == names[:3]

    def test_target_resolution(self):
        assert target.resolve(["DEFASAGEM_2021", "DEFASAGEM_2022"], 2021) == "DEFASAGEM_2021"
        assert target.resolve(["DEFASAGEM_2020", "DEFASAGEM_2021"], 2022) == "DEFASAGEM_2021"
        assert target.resolve(["DEFASAGEM"], 2022) == "DEFASAGEM"
        with pytest.raises(ValueError):
            target.resolve(["INDE_2022"], 2022)

    def test_common_columns(self, frame):
        a, b = frame("x double, y int, t string", (1.0, 1, "")), frame("y int, t string, z int", (1, "", 1))
        assert columns.common_columns(a, b) == ["y"]

    def test_names_with_dots(self, frame):
        df = frame("`a.b` double", (1.0,), (None,))
        assert impute.impute(df, ["a.b"], "mean").select(named("a.b")).collect()[1][0] == 1.0


class TestExpressions:
    def test_row_statistics_skip_nulls(self, frame):
        df = frame("a double, b double, c double", (5.0, 6.0, 7.0), (None, 4.0, None), (None, None, None))
        rows = df.selectExpr(f"{row_mean(list('abc'))} AS m", f"{row_std(list('abc'))} AS s").collect()
        assert [r["m"] for r in rows] == [6.0, 4.0, None]
        assert [r["s"] for r in rows] == [1.0, 0.0, 0.0]

    def test_number_from_text(self, frame):
        df = frame("t string", ("7.5",), ("7D",), (" 3 ",), ("nan",), ("1e2",), (None,))
        kind = df.schema["t"].dataType
        assert [r[0] for r in df.selectExpr(number("t", kind)).collect()] == [7.5, None, 3.0, None, 100.0, None]

    def test_ordinal_levels(self, frame):
        df = frame("t string", *[(t,) for t in C.ORDINAL_LEVELS], ("?",), (None,))
        assert [r[0] for r in df.selectExpr(ordinal_code("t", C.ORDINAL_LEVELS)).collect()] == [*C.ORDINAL_LEVELS.values(), 0, 0]

    def test_class_names(self, frame):
        assert [r[0] for r in frame("y int", (0,), (1,), (7,)).select(class_name(F.col("y"))).collect()] == [
            "Sem Risco (0)", "Em Risco (1)", "7"]


class TestImpute:
    def test_median(self, frame):
        df = frame("A double, B double", (1.0, 10.0), (2.0, None), (None, 30.0), (4.0, 40.0))
        out = impute.impute(df, ["A", "B"]).collect()
        assert out[2]["A"] == 2.0 and out[1]["B"] == 30.0

    def test_mean(self, frame):
        df = frame("A double", (1.0,), (2.0,), (None,), (3.0,))
        assert impute.impute(df, ["A"], "mean").collect()[2]["A"] == 2.0

    def test_nan_is_null(self, frame):
        df = frame("A double", (1.0,), (float("nan"),), (3.0,))
        assert impute.impute(df, ["A"], "mean").collect()[1]["A"] == 2.0

    def test_mode_and_its_ties(self, frame):
        df = frame("cat string, tie string", ("A", "z"), ("A", "y"), ("B", None), (None, None))
        out = impute.impute(df, ["cat", "tie"], "mode").collect()
        assert out[3]["cat"] == "A" and out[3]["tie"] == "y"

    def test_all_null_column_stays(self, frame):
        df = frame("a double, t string", (None, None), (None, None))
        assert impute.impute(df, ["a"]).where("a is null").count() == 2
        assert impute.impute(df, ["t"], "mode").where("t is null").count() == 2

    def test_drop(self, frame):
        df = frame("A double, B double", (1.0, 10.0), (None, 20.0), (3.0, 30.0))
        assert impute.drop_incomplete(df).count() == 2
        assert impute.drop_incomplete(df, ["B"]).count() == 3

    def test_approximate_median(self, spark):
        df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
        assert impute.fit(df, ["x"], "approx_median").head()["fill"] == 500.0

    def test_unknown(self, frame):
        with pytest.raises(ValueError):
            impute.fit(frame("a double", (1.0,)), ["a"], "magic")


class TestEncodeAndScale:
    def test_catalog_and_unseen(self, frame):
        df = frame("k int, t string", (1, "B"), (2, "A"), (3, "C"), (4, "A"))
        classes = encode.catalog(df, ["t"])
        assert {r["value"]: r["index"] for r in classes.collect()} == {"A": 0, "B": 1, "C": 2}
        new = frame("k int, t string", (1, "C"), (2, "?"), (3, None))
        assert [r["t"] for r in encode.apply(new, classes, ["t"]).orderBy("k").collect()] == [2, -1, -1]
        assert [r["t"] for r in encode.apply_like_batch(new, classes, ["t"]).orderBy("k").collect()] == [0, 0, 0]

    def test_other_columns_pass_the_joins_as_one(self, frame):
        names = ["a.b", "_rest", "_text0", *[f"c{i}" for i in range(30)]]
        rows = [(t, u, *[f"{k}{n}" if k else None for n in names]) for k, (t, u) in enumerate([("x", "u"), (None, "v"), ("y", None), ("z", "u"), ("x", "u"), ("x", "u")])]
        df = frame("t string, u string, " + ", ".join(f"`{n}` string" for n in names), *rows)
        classes = frame("column string, value string, index bigint", ("t", "x", 0), ("t", "y", 1), ("u", "u", 0), ("u", "v", 1), ("u", "x", 5))
        coded = encode.apply(df, classes, ["t", "u"])
        codes = {"t": {"x": 0, "y": 1}, "u": {"u": 0, "v": 1}}
        assert coded.columns == df.columns
        assert sorted(map(repr, coded.collect())) == sorted(repr(r.__class__(**{**r.asDict(), **{c: codes[c].get(r[c], -1) for c in codes}})) for r in df.collect())
        node = coded._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().head()
        assert node.output().size() < 10

    def test_large_catalog_is_dense(self, spark):
        df = spark.range(5000).select(F.concat(F.lit("v"), F.lpad("id", 6, "0")).alias("t"))
        classes = encode.catalog(df, ["t"])
        assert classes.where("int(substr(value, 2)) = index").count() == 5000

    def test_ordinal(self, frame):
        df = frame("PEDRA_2022 string", ("Quartzo",), ("Ágata",), ("Ametista",), ("Topázio",))
        assert [r[0] for r in encode.ordinal(df, encode.ordinal_columns(df)).collect()] == [1, 2, 3, 4]

    def test_scale(self, frame):
        df = frame("A double, c double", *[(float(i), 3.0) for i in range(1, 6)])
        out = scale.apply(df, scale.fit(df, ["A", "c"]), ["A", "c"])
        r = out.agg(F.avg("A").alias("m"), F.stddev_pop("A").alias("s"), F.max("c").alias("c")).head()
        assert abs(r["m"]) < 1e-12 and abs(r["s"] - 1) < 1e-12 and r["c"] == 0.0


class TestTarget:
    def test_negative_is_risk(self, frame):
        df = frame("d int", (-2,), (0,), (3,), (None,))
        assert sorted(r["label"] for r in target.binarize(df, "d").collect()) == [0, 0, 1]

    def test_binary_and_detection(self, frame):
        two, three = frame("d int", (0,), (1,), (1,)), frame("d int", (-1,), (0,), (2,))
        assert sum(r["label"] for r in target.binarize(two, "d", "detect").collect()) == 2
        assert sum(r["label"] for r in target.binarize(three, "d", "detect").collect()) == 1
        with pytest.raises(ValueError):
            target.binarize(two, "d", "other")

    def test_weights(self, frame):
        rows = target.class_weights(frame("y int", (0,), (0,), (0,), (1,)), "y").collect()
        assert {r["label"]: r["weight"] for r in rows} == {0: 4 / 6, 1: 2.0}


class TestContract:
    RULES = {"INDE_2022": (0, 10), "FASE_2022": (0, 8)}

    def test_split(self, frame):
        df = frame("k int, INDE_2022 double, FASE_2022 int", (1, 10.0, 8), (2, 10.1, 9), (3, None, None))
        valid, bad = contract.split(df, self.RULES)
        assert sorted(r["k"] for r in valid.collect()) == [1, 3]
        assert bad.head()["violations"] == ["INDE_2022", "FASE_2022"]
        assert {r["rule"]: r["n_violations"] for r in contract.violation_counts(df, self.RULES).collect()} == {"INDE_2022": 1, "FASE_2022": 1}

    def test_rules_of_a_full_record(self):
        stems = list(C.CONTRACT_BOUNDS)
        names = [f"{s}_{y}" for s in stems for y in (2020, 2021, 2022)]
        assert len(contract.panel_rules(names, (2020, 2021, 2022))) == 36
