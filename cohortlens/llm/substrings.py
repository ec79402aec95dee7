"""Operator 10, substring deduplication with repeated-phrase automata.

A window is `window` words in a row. From every window one phrase of `phrase` words is chosen by hash, the same wherever the
window stands, so windows that recur share a phrase that recurs.

1. Phrases are counted over all documents; those that occur once are done with.
2. The recurring phrases are joined back to their texts by hash, which already finds every occurrence that a window
   chose. For each block of documents an Aho-Corasick automaton is compiled from the recurring phrases of the block (the
   shard) and walks over the same documents; it reports these places again and decides nothing. The windows that chose an
   occurrence form a segment.
3. Segments are counted. All windows of a segment that recurs do so too. Where a phrase stands in different segments, as
   at the edges of a shared passage, the single windows of the distinct segments are counted.
4. The words of recurring windows are removed.

Windows are compared by a 64-bit hash together with the 64-bit hash of their phrase. Texts go through one shuffle, those
with a recurring phrase through a second one; a phrase, segment or text that is very frequent is counted before
the shuffle and otherwise only met in joins whose other side has one row for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import GAP, text_blocks
from cohortlens.session import materialize

_FACTOR = 0x9E3779B97F4A7C15 | 1
_PIECE = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PLACE = (1 << 24) - 1


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of the words of about 4 MB."""
    data = (text or "").encode()
    begin = 0
    while begin < len(data):
        gap = _SPACE.search(data, begin + _PIECE)
        end = gap.start() if gap else len(data)
        yield data[begin:end].split()
        begin = end


def window_blocks(text: str | None, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """Pieces of the words of a text, each with the number of its first word, that hold every window exactly once."""
    first, held = 0, []
    for words in word_blocks(text):
        held.extend(words)
        if len(held) >= window:
            yield first, held
            first, held = first + len(held) - window + 1, held[len(held) - window + 1:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` codes: the hash of a run is that of its first part plus the shifted one of the rest."""
    out, done = np.zeros(len(codes) - length + 1, np.uint64), 0
    power, size = codes, 1
    while done < length:
        if length & size:
            factor = np.uint64(pow(_FACTOR, done, 1 << 64))
            out += power[done:done + len(out)] * factor
            done += size
        power = power[:len(power) - size] + power[size:] * np.uint64(pow(_FACTOR, size, 1 << 64)) if 2 * size <= length else power
        size *= 2
    return out


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """Least value of every run of `length` values."""
    size, power = 1, values
    while 2 * size <= length:
        power = np.minimum(power[:len(power) - size], power[size:])
        size *= 2
    rest = length - size
    return np.minimum(power[:len(power) - rest], power[rest:]) if rest else power


def chosen(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of at least `window` words: word hashes, phrase hashes, and the place of the phrase that each window chooses."""
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes = _mixed(_runs(codes, phrase))
    # the place in the low bits makes the first of equal phrases win
    ranked = (_mixed(hashes) & ~np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    return codes, hashes, (_least(ranked, window - phrase + 1) & np.uint64(_PLACE)).astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with two 64-bit hashes of the text; together they stand for the text."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"))


def _phrases(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            lists = []
            for text in batch.column("text").to_pylist():
                own = [np.zeros(0, np.int64)]
                for _, words in window_blocks(text, window):
                    _, hashes, place = chosen(words, window, phrase)
                    own.append(hashes[place[np.concatenate([[True], place[1:] != place[:-1]])]].view(np.int64))
                lists.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(lists, pa.list_(pa.int64()))], names=["k1", "k2", "phrases"])

    return run


_SEGMENT = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "n": pa.int32(), "phrase": pa.int64(), "segment": pa.int64(), "windows": pa.list_(pa.int64())}


def _segments(window: int, phrase: int):
    """Compile the automaton of a block from its recurring phrases, stream the texts, return the segments located."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 2 << 20):
            pieces = []
            number: dict[bytes, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for k1, k2, text, recurring in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "recurring"))):
                recurring = np.array(recurring, np.int64).view(np.uint64)
                for first, words in window_blocks(text, window):
                    codes, hashes, place = chosen(words, window, phrase)
                    ids = tuple([number.setdefault(w, len(number)) for w in words])
                    places = place[np.concatenate([[True], place[1:] != place[:-1]])]
                    for p in places[np.isin(hashes[places], recurring)].tolist():
                        automaton.add_word(ids[p:p + phrase], 1)
                    pieces.append((k1, k2, first, codes, hashes, place, ids))
            if not len(automaton):
                continue
            automaton.make_automaton()
            out: dict[str, list] = {k: [] for k in _SEGMENT}
            for k1, k2, first, codes, hashes, place, ids in pieces:
                located = np.zeros(len(hashes), bool)
                located[[end - phrase + 1 for end, _ in automaton.iter(ids)]] = True
                full = _mixed(_runs(codes, window))
                begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.append(begins[1:], len(place))
                hit = located[place[begins]]
                begins, ends = begins[hit], ends[hit]
                # first and last window overlap, so their hashes and the number of windows stand for all words
                segment = _mixed(full[begins] + _mixed(full[ends - 1] + (ends - begins).astype(np.uint64)))
                out["k1"].extend([k1] * len(begins))
                out["k2"].extend([k2] * len(begins))
                out["start"].extend((first + begins).tolist())
                out["n"].extend((ends - begins).tolist())
                out["phrase"].extend(hashes[place[begins]].view(np.int64).tolist())
                out["segment"].extend(segment.view(np.int64).tolist())
                signed = full.view(np.int64)
                out["windows"].extend(signed[b:e] for b, e in zip(begins.tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in _SEGMENT.items()], names=list(_SEGMENT))

    return run


def _remover(with_texts: bool):
    """Remove the words of the ranges: id, n_words, n_removed, kept_sha256, and the kept text if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            total, removed, digests, texts = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                size = sum(map(len, word_blocks(text)))
                edge = np.zeros(size + 1, np.int64)
                for r in ranges or ():
                    edge[r["begin"]] += 1
                    edge[r["end"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept, at = [], 0
                for words in word_blocks(text):
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone[at:at + len(words)])]))
                    at += len(words)
                joined = b" ".join(k for k in kept if k)
                total.append(size)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_texts:
                    texts.append(joined.decode())
            arrays = [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_texts:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def recurring_ranges(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(k1, k2, ranges): begin and end in words of what recurs, for keyed rows (id, text, k1, k2) that hold a recurring phrase."""
    segments = materialize(docs.mapInArrow(_segments(window, phrase), "k1 bigint, k2 bigint, start int, n int, phrase bigint, segment bigint, windows array<bigint>"), "substring-segments")
    counted = materialize(segments.groupBy("phrase", "segment").agg(F.count("*").alias("times"), F.first("windows").alias("windows")), "substring-counts")
    mixed = counted.groupBy("phrase").agg(F.count("*").alias("forms")).where("forms > 1").select("phrase")
    mixed = materialize(mixed, "substring-mixed")
    single = counted.join(mixed, "phrase").select("phrase", "segment", "times", F.posexplode("windows").alias("at", "w"))
    single = materialize(single, "substring-windows")
    again = single.groupBy("phrase", "w").agg(F.sum("times").alias("times")).where("times > 1").select("phrase", "w")
    again = materialize(again, "substring-windows-again")
    some = single.where("times = 1").join(again, ["phrase", "w"]).groupBy("phrase", "segment").agg(F.collect_set("at").alias("ats"))
    all_ = counted.where("times > 1").select("phrase", "segment", F.lit(None).cast("array<int>").alias("ats"))
    verdict = all_.unionByName(some)

    def cover(begin, end):
        return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))

    start, n = F.col("start"), F.col("n")
    ranges = F.when(F.col("ats").isNull(), F.array(cover(start, start + n + window - 1))).otherwise(
        F.transform("ats", lambda at: cover(start + at, start + at + window)))
    hits = segments.select("k1", "k2", "start", "n", "phrase", "segment").join(verdict, ["phrase", "segment"])
    return hits.select("k1", "k2", ranges.alias("r")).groupBy("k1", "k2").agg(F.flatten(F.collect_set("r")).alias("ranges"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, phrase: int = 8, texts: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, and with `texts` also `kept`, the kept words joined by one space.

    A word goes if a window that covers it occurs anywhere else, in another row or elsewhere in the same one; all
    windows are judged on the input. A null text has no word. Rows that repeat a text, with whatever ids, are documents of
    their own, so their windows recur. An empty table gives an empty result; other columns are not read.
    """
    if not 0 < phrase <= window or window - phrase >= window:
        raise ValueError("phrase must be between 1 and window")
    rows = _keyed(docs, id_col, text_col)
    listed = rows.mapInArrow(_phrases(window, phrase), "k1 bigint, k2 bigint, phrases array<bigint>").where(F.size("phrases") > 0)
    distinct = materialize(listed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("phrases").alias("phrases")), "substring-phrases")
    single = distinct.select("k1", "k2", "copies", F.explode("phrases").alias("phrase"))
    # written, so that a very frequent phrase can be split in the join: an aggregate below a join fixes its partitions
    often = single.groupBy("phrase").agg(F.sum("copies").alias("times")).where("times > 1").select("phrase")
    often = materialize(often, "substring-recurring")
    marked = single.select("k1", "k2", "phrase").join(often, "phrase").groupBy("k1", "k2").agg(F.collect_set("phrase").alias("recurring"))
    joined = rows.join(marked, ["k1", "k2"], "left")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), GAP), lambda w: w != "")
    is_open = F.col("recurring").isNotNull()
    plain = F.when(~is_open, words)
    kept = F.array_join(plain, " ")
    held = materialize(joined.select(
        "id", "k1", "k2", F.when(is_open, F.col("text")).alias("text"), "recurring",
        F.size(plain).cast("long").alias("n_words"), F.sha2(kept, 256).alias("kept_sha256"), *[kept.alias("kept")] * texts), "substring-texts")
    candidates = held.where(is_open)
    ranges = recurring_ranges(candidates.select("k1", "k2", "text", "recurring"), window, phrase)
    cut = candidates.select("id", "k1", "k2", "text").join(ranges, ["k1", "k2"], "left").select("id", "text", "ranges")
    kind = rows.schema["id"].dataType.simpleString()
    columns = ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
    done = cut.mapInArrow(_remover(texts), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts)
    untouched = held.where(~is_open).withColumn("n_removed", F.lit(0).cast("long")).select(columns)
    return done.unionByName(untouched).withColumnRenamed("id", id_col)
