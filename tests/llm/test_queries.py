import hashlib
import os

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cohortlens.llm.queries import ORACLE, QUERIES
from cohortlens.llm.tokenizer import library

SF = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def test_every_operator_has_a_registered_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_statement(spark, name):
    from check_oracle import compare, connect

    ok, _, _, message = compare(spark, connect(SF_ORACLE), SF_ORACLE, name)
    assert ok, message


@pytest.mark.parametrize("name,columns", [
    ("op1_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op2_simhash", ["doc_id", "fingerprint", "component_id"]),
    ("op3_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    ("op4_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op5_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op6_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
])
def test_query_returns_every_document_with_the_columns_of_its_contract(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert df.columns[:len(columns)] == columns
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_encoding_query_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = library(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op6_bpe"](spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, kept = docs.columns, [docs.count()], {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = os.path.join(str(tmp_path), str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]
    assert sizes[0] > sizes[2] and sizes[1] >= sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0.6 * sizes[0]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == sizes[-1]
    same = whole.join(docs.select("doc_id", F.col("ids_sha256").alias("h")), "doc_id").where("h = ids_sha256").count()
    assert same == sizes[-1]


def test_stages_take_messy_and_empty_tables_with_columns_of_any_name(spark, messy):
    messy = messy.withColumn("n_chars", F.length("text").cast("long"))
    want = {"toxicity": 12, "benchmark_decontamination": 12, "pii": 12, "bpe": 12, "simhash_near_dedup": 7}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy, SF)
        assert name == "bpe" or out.columns == messy.columns
        rows = out.collect()
        assert len(rows) == want[name], name
        assert stage(spark, messy.limit(0), SF).count() == 0
    once = corpus_pipeline.drop_near_duplicates(spark, messy, SF).collect()
    # null, empty and blank texts are one group, and so are the copies of a text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in once)[:3] == [(False, 1), (False, 4), (False, 5)]


@pytest.mark.parametrize("name", ["op11_divergence", "op12_suffix_dedup", "op13_hard_negatives"])
def test_operators_with_a_result_of_their_own(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == {
        "op11_divergence": ["lang", "source", "part", "item", "value", "rank"],
        "op12_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]}[name]
    assert df.count() > 0
