"""Registered queries of the training-data operators, each over its whole tables, with the SQL where there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import bpe, chat, decontaminate, divergence, hard_negatives, language_id, pii, quality, simhash, substrings, suffix_arrays, token_counts, toxicity
from cohortlens.llm.common import crc_mod, table
from cohortlens.llm.oracle import STATEMENTS
from cohortlens.session import with_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = STATEMENTS

TOKENIZER = "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(with_scratch(spark), sf_dir.rstrip("/"))

    QUERIES[fn.__name__] = run
    return run


def _remainder_is(parts: int, remainder: int):
    """Whether crc32 of doc_id as text leaves that remainder; false for a null id."""
    return F.coalesce(crc_mod(F.col("doc_id"), parts) == remainder, F.lit(False))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", _remainder_is(4, 2).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = toxicity.fit_from_labels(docs.where(learn), labels.where(learn))
    return toxicity.score(docs, model).select("doc_id", _remainder_is(5, 0).alias("held_out"), "score", "predicted")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ids=False, digests=True)


def _conversation_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted turns, one conversation after the other; the state is that of the open hashes.

    A digest of this form can only be taken in order, so the turns of one conversation pass through one task, one by one.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, turns, loss, counts = None, None, None, [0, 0, 0]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if turns is None or row["conv_id"] != conv:
                if turns is not None:
                    rows.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                conv, turns, loss, counts = row["conv_id"], hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            turns.update(f"{row['role']}\n{row['text']}\n".encode())
            counts[0] += 1
            if row["trained"] is not None:
                loss.update(row["trained"].encode())
                counts[1] += len(row["trained"])
                counts[2] += row["chars"]
        yield made(rows)
    if turns is not None:
        yield made([(conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])])


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_examples(chat.format_turns(turns))
    in_order = back.repartition("conv_id").sortWithinPartitions("conv_id", "ordinal")
    return in_order.mapInArrow(_conversation_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def text(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT) AS n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), texts=False)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.deduplicate(table(spark, sf_dir, "documents"), bytes_too=False)
