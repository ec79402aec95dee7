import pytest
from pyspark.sql import functions as F

CLASHES = ("id", "row", "fp", "key", "k1", "score", "kind", "matches", "doc", "ranges", "n_words", "text_2")


@pytest.fixture
def docs(spark):
    """docs((1, "a text"), ...): documents with a language and with columns whose names the operators use themselves."""
    def make(*rows):
        rows = [(*r, "en") if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])

    return make


MESSY = (
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words here"), (None, None),
    (5, "The same text again, the same text again."), (6, "The same text again, the same text again."),
    (7, "x" * 50_000), (8, "long " * 30_000), (9, "ÄÖÜ ß é 中文 😀 \x1c\x85 <|endoftext|>"),
)


@pytest.fixture
def messy(docs):
    return docs(*MESSY)
