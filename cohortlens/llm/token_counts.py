"""Operator 3, token counts by overlap resynchronisation.

Documents up to `chunk_chars` are counted where they are read. Longer ones are cut into overlapping chunks that any
task can encode; the encodings are spliced at a common border of pieces, proven in both:

* the left chunk's encoding is the document's up to its last `margin` characters, because a piece depends on the text
  from its own start to a few characters behind it;
* from a border of pieces on, an encoding depends only on what follows. A place that is a border in the left chunk
  (which is right there) and in the right chunk is therefore a border of the document, and the right chunk is right
  from there.

Where two neighbours share no such border (a run of letters longer than the overlap), the document is cut again with
chunks and overlaps `widen` times as long, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import tokenizer as T
from cohortlens.llm.common import batch_of, text_blocks, texts_of
from cohortlens.session import materialize

_KEPT = 200_000  # counts of short parts that a task remembers
_SHORT = 48  # characters of a part worth remembering


class Counter:
    """Token counts of texts as the library gives them, each distinct part of a block encoded once."""

    def __init__(self, path: str):
        T.read(path)
        self.tokenizer, self.known = T.library(path), {}

    def _encode(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 4096):
            block = parts[i:i + 4096]
            encoded = self.tokenizer.encode_batch_fast(block, add_special_tokens=False)
            self.known.update(zip(block, map(len, encoded)))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [T.space_cuts(t) for t in texts]
        if len(self.known) > _KEPT:
            self.known = {}
        first = {c[0] for c in cut}
        rest = {" " + p for p in set(chain.from_iterable(c[1:] for c in cut))}
        self._encode([p for p in first | rest if p not in self.known])
        after = {p[1:]: self.known[p] for p in rest}
        totals = [self.known[c[0]] + sum(map(after.__getitem__, c[1:])) for c in cut]
        self.known = {p: n for p, n in self.known.items() if len(p) <= _SHORT}
        return totals


def borders(encoding) -> tuple[list[int], list[int]]:
    """Start in characters and number of the first token of every piece."""
    places, tokens, last = [], [], None
    for number, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last:
            places.append(start)
            tokens.append(number)
            last = word
    return places, tokens


_CHUNK = {
    "key": pa.string(), "chunk": pa.int64(), "n_tokens": pa.int64(), "head": pa.list_(pa.int64()),
    "head_token": pa.list_(pa.int64()), "tail": pa.list_(pa.int64()), "tail_token": pa.list_(pa.int64()),
}


def _chunk_encoder(path: str, overlap: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.read(path)
        tokenizer = T.library(path)
        margin = max([len(t["content"]) for t in T.read(path)["added_tokens"]] + [0]) + 4
        for batch in text_blocks(batches, "text", 1 << 20):
            columns = {k: [] for k in _CHUNK}
            for key, chunk, start, text in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "start", "text"))):
                encoding = tokenizer.encode(text, add_special_tokens=False)
                places, tokens = borders(encoding)
                head = [(start + p, t) for p, t in zip(places, tokens) if p <= overlap]
                tail = [(start + p, t) for p, t in zip(places, tokens) if len(text) - overlap <= p <= len(text) - margin]
                for name, value in zip(_CHUNK, (key, chunk, len(encoding), *zip(*head), *((), ()) * (not head), *zip(*tail), *((), ()) * (not tail))):
                    columns[name].append(value)
            yield batch_of(_CHUNK, **columns)

    return encode


def splice(chunks: pd.DataFrame) -> int | None:
    """Tokens of one document from its encoded chunks in order; none if two neighbours share no border."""
    total, entry, since = 0, 0, 0
    rows = list(chunks.itertuples())
    for left, right in zip(rows, rows[1:]):
        at = dict(zip(right.head, right.head_token))
        common = next(((p, t) for p, t in zip(left.tail, left.tail_token) if p >= since and p in at), None)
        if common is None:
            return None
        since = common[0]
        total += common[1] - entry
        entry = at[since]
    return int(total + rows[-1].n_tokens - entry)


def _splice(chunks: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("chunk")
    return pd.DataFrame({"key": [chunks["key"].iloc[0]], "n_tokens": pd.array([splice(chunks)], dtype="Int64")})


def long_counts(texts: DataFrame, path: str, chunk_chars: int, overlap: int, widen: int) -> DataFrame:
    """(key, n_tokens) of the distinct texts (key, text), however long; one round for each widening that is needed."""
    if not 64 <= overlap * 4 <= chunk_chars or widen < 2:
        raise ValueError("chunk_chars must be at least 4 times overlap, overlap at least 16, widen at least 2")
    done, left = None, texts
    while True:
        stride = chunk_chars - overlap
        last = F.greatest(F.lit(0), F.ceil((F.length("text") - F.lit(overlap)) / F.lit(stride)) - 1).cast("int")
        chunks = (
            left.select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
            .select("key", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * stride).alias("start"),
                    F.substring("text", F.col("chunk") * stride + 1, F.lit(chunk_chars)).alias("text"))
            .repartition("key", "chunk")
        )
        encoded = chunks.mapInArrow(_chunk_encoder(path, overlap), _ddl(_CHUNK))
        counted = materialize(encoded.groupBy("key").applyInPandas(_splice, "key string, n_tokens bigint"), "token-counts")
        ready = counted.where("n_tokens IS NOT NULL")
        done = ready if done is None else done.unionByName(ready)
        failed = counted.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return done
        left = materialize(texts.join(failed, "key"), "token-counts-again")
        chunk_chars, overlap = chunk_chars * widen, overlap * widen


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{k} {names[v]}" for k, v in schema.items())


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    chunk_chars: int = 65_536, overlap: int = 2_048, widen: int = 4,
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above `limit`).

    `path` is a byte-level BPE file of the tokenizers library. Null text counts as empty: no byte, no token. Ids are
    only passed through, so null and repeated ids and repeated rows each keep their own row; an empty table gives an
    empty result. Other input columns are not read and cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in text_blocks(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), batch.column("key"), pa.array(counter.counts(texts_of(batch, "text")), pa.int64())],
                names=["id", "n_bytes", "key", "n_tokens"])

    # the key of a long text is made of the text, so that equal long texts are encoded once
    prepared = rows.select(
        "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.when(is_long, F.sha2("text", 256)).alias("key"), F.when(~is_long, F.col("text")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = prepared.mapInArrow(short, f"id {kind}, n_bytes bigint, key string, n_tokens bigint")
    long_texts = rows.where(is_long).select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    long = long_counts(materialize(long_texts, "long-texts"), path, chunk_chars, overlap, widen)
    tokens = F.coalesce(F.col("long.n_tokens"), F.col("short.n_tokens"))
    return counted.alias("short").join(long.alias("long"), F.col("short.key") == F.col("long.key"), "left").select(
        F.col("short.id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
