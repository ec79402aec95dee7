"""From documents to token ids: toxicity, near-duplicates, benchmark leaks, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
other columns there are and whatever their names. Rows are judged one by one by their text: null and repeated ids and repeated rows are
rows like any other, texts are read whole however long they are, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import bpe, decontaminate, pii, simhash, toxicity
from cohortlens.llm.common import crc_mod, table
from cohortlens.session import materialize, with_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier learned from confirmed toxic and unlabelled texts rejects.

    A null text counts as empty. Rows with equal texts go or stay together; a score of just 0.5 goes. Without usable labels all stay.
    """
    with_scratch(spark)
    learn = crc_mod(F.col("doc_id"), 5) != 0
    model = toxicity.fit_from_labels(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: that of the smallest id, a null id after all others.

    Of rows with the same id and text one stays. Texts without a word, null ones included, have fingerprint zero and link
    with each other like any others, so one of them stays.
    """
    with_scratch(spark)
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item. A null text holds none; rows with equal texts go or stay together."""
    with_scratch(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the new text. Texts without any, null ones included, stay as they are.

    Every row stays. Spans that overlap are replaced together, by the kind of the first.
    """
    with_scratch(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with the digests of ids and decoded text; a null text has no tokens. Every row stays."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: No SQL form: the stages train a classifier, hash with XXH64 and tile texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has written."""
    sf_dir = sf_dir.rstrip("/")
    docs = table(with_scratch(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
