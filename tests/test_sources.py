import pytest
from pyspark.sql import functions as F

from cohortlens.sources import files, logs, star, synthetic


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_and_types(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in [("a", "b", "c", "d"), ("1", "2.5", "x", "1"), ("2", "NaN", "#NULL!", ""), ("3", "4", "y", "2")])
    df = files.read_csv(spark, write(tmp_path / "f.csv", text))
    assert [k for _, k in df.dtypes] == ["bigint", "double", "string", "bigint"]
    assert df.where("b is null and c is null and d is null").count() == 1


def test_schema_skips_inference(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "f.csv", "a,b\n1,NaN\n2,3\n"), schema="a int, b double")
    assert [r["b"] for r in df.orderBy("a").collect()] == [None, 3.0]


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        files.read_csv(spark, "/tmp/x.txt")


def test_discovery(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.discover_csv(spark, str(tmp_path))
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "b.csv", "x,y\n3,4\n")
    write(tmp_path / "note.txt", "hello")
    df = files.discover_csv(spark, str(tmp_path), schema="x int, y int")
    assert sorted(r["x"] for r in df.collect()) == [1, 3]
    assert {r["source_file"].rsplit("/", 1)[1] for r in df.collect()} == {"a.csv", "b.csv"}


def test_columns_are_matched_by_header(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\n1,2\n")
    write(tmp_path / "b.csv", "y,x\n20,10\n")
    write(tmp_path / "c.csv", "y;z\n200;7\n")
    for schema in (None, "x bigint, y bigint, z bigint"):
        rows = files.read_csv(spark, str(tmp_path), schema).collect()
        assert sorted(((r["x"], r["y"], r["z"]) for r in rows), key=str) == [(1, 2, None), (10, 20, None), (None, 200, 7)]


def test_discovery_below_subfolders_only(spark, tmp_path):
    (tmp_path / "one" / "two").mkdir(parents=True)
    write(tmp_path / "one" / "two" / "a b.csv", "x;y\n1;2\n")
    assert [(r["x"], r["y"]) for r in files.discover_csv(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "f.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n')
    assert [(r["a"], r["b"]) for r in files.read_csv(spark, path).orderBy("a").collect()] == [(1, "two\nlines"), (2, 'say "hi"')]


def test_long_ids_keep_their_digits(spark, tmp_path):
    path = write(tmp_path / "f.csv", f"a,b,c\n1234567890123456789,{'9' * 30},{'9' * 50}\n1234567890123456788,1,2\n")
    df = files.read_csv(spark, path)
    assert [k for _, k in df.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert {r["a"] for r in df.collect()} == {1234567890123456789, 1234567890123456788}


def test_log_days_are_pruned(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    rows = frame("timestamp string, input_data string, prediction int, risk_level string, probability_at_risk double, model_type string",
                 ("2024-01-01 10:00:00", "{}", 1, "HIGH", 0.5, "m"), ("2024-01-03 10:00:00", "{}", 0, "LOW", 0.1, "m"))
    logs.append(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    assert logs.read(spark, path, since="2024-01-02").count() == 1 and logs.read(spark, path).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = synthetic.generate(spark, 60)
    back = files.read_csv(spark, files.write_csv(df, str(tmp_path / "out")))
    assert back.columns == df.columns and back.count() == 60
    assert back.agg(F.sum("INDE_2020")).head()[0] == pytest.approx(df.agg(F.sum("INDE_2020")).head()[0])


def test_prediction_log(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    assert logs.read(spark, path).count() == 0
    scored = frame("a int, b string, prediction int, risk_level string", (1, None, 1, "HIGH"))
    rows = logs.prediction_rows(scored, ["a", "b"], "2024-01-01 10:11:12.345678")
    logs.append(rows, path)
    logs.append(rows, path)
    back = logs.read(spark, path).collect()
    assert len(back) == 2 and back[0]["input_data"] == '{"a":1}' and back[0]["probability_at_risk"] is None
    assert back[0]["timestamp"].microsecond == 345678


def test_corrupt_lines_go_to_quarantine(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", '{"prediction": 1, "risk_level": "HIGH"}\n\n{broken\n')
    good, bad = logs.read_with_quarantine(spark, path)
    assert good.head()["risk_level"] == "HIGH" and good.count() == 1
    assert bad.head()["value"] == "{broken"


class TestSynthetic:
    def test_shape_and_ranges(self, spark):
        df = synthetic.generate(spark, 400)
        assert len(df.columns) == 46 and df.count() == 400
        r = df.agg(F.min("INDE_2020"), F.max("INDE_2020"), F.min("IDADE_ALUNO_2022"), F.max("IDADE_ALUNO_2022"), F.max("FASE_2021"),
                   F.count_if(F.col("PEDRA_2020").isNull())).head()
        assert 0 <= r[0] and r[1] <= 10 and 9 <= r[2] and r[3] <= 19 and r[4] <= 8 and r[5] == 0

    def test_rates(self, spark):
        df = synthetic.generate(spark, 4000)
        r = df.agg(F.avg("BOLSISTA_2020"), F.avg("PONTO_VIRADA_2020"), F.avg(F.col("INDE_2020").isNull().cast("int")), F.avg("DEFASAGEM_2022")).head()
        assert abs(r[0] - 0.2) < 0.03 and abs(r[1] - 0.3) < 0.03 and abs(r[2] - 0.05) < 0.015 and 0.1 < r[3] < 0.9

    def test_same_rows_for_any_partitioning(self, spark):
        a = synthetic.generate(spark, 200)
        b = synthetic.generate(spark, 200).repartition(13)
        assert a.exceptAll(b).count() == 0
        assert a.exceptAll(synthetic.generate(spark, 200, seed=1)).count() > 0


def test_whole_numbers_are_those_of_round(spark, frame):
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, 0.07 * 100, 1.005 * 100, 4503599627370495.5, 4503599627370496.0, 9e15, None]
    df = frame("x double", *[(v,) for v in values]).union(spark.range(2000).selectExpr("(id - 1000) / 8D"))
    assert df.where(f"NOT ({star.whole('x')} <=> cast(round(x) AS bigint))").count() == 0
    for wrong in ("NaN", "Infinity", "1e300"):
        with pytest.raises(Exception, match="CAST_OVERFLOW"):
            frame("x string", (wrong,)).selectExpr("cast(x AS double) AS x").selectExpr(star.whole("x")).collect()


def test_the_panel_rounds_ties_only_by_decimals(spark, frame, tmp_path):
    frame("l_orderkey bigint, l_quantity double, l_discount double, l_tax double, l_returnflag string", (1, 2.5, 0.07, 0.005, "R"), (1, 3.5, 0.29, 0.02, "A")).write.parquet(f"{tmp_path}/lineitem.parquet")
    frame("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    columns = ("IDA", "INDE")
    text = star.panel(spark, str(tmp_path), columns)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("rint(") >= 2 * text.count("round(") > 0
