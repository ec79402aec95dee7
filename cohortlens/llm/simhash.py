"""Operator 2, SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree in one of d + 1 blocks of bits. For each block they are turned so
that the block leads, and sorted by Gray rank: neighbours then share leading bits and mostly differ in few others. Runs of
neighbours form the lowest nodes of an index, runs of nodes the next ones, up to one node per value of the block. A
node keeps the bits that all below it share (mask and pattern). Pairs of nodes are followed from the top; the shared
bits in which they differ bound the difference of all pairs below, so that whole groups are pruned when they exceed d, or
linked at once when even the bits that are not shared cannot exceed it. Nodes that are already in one component are not
followed either. Tasks return links that span the components of what they hold, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import text_blocks, texts_of
from cohortlens.llm.components import components
from cohortlens.session import materialize

SEED = 42
_BLOCK = 1 << 16
_FANOUT = 8
_PAIRS = 1 << 18


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text: lower-cased A-Z, words between ASCII white space, repeats count."""
    words = text.encode().lower().split()  # both only touch ASCII
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = min(words_per_shingle, len(words))
    begins, ends = begins[:len(words) - size + 1], ends[size - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(begins), _BLOCK):
        hashes = [digest(data[s:e], SEED) for s, e in zip(begins[k:k + _BLOCK].tolist(), ends[k:k + _BLOCK].tolist())]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(begins)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            made = np.array([fingerprint(t, words_per_shingle) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _bits(blocks: int) -> list[tuple[int, int]]:
    """Place and width of each block of the 64 bits, from the highest."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _turned(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of the fingerprint with its blocks in another order."""
    out, at = F.lit(0).cast("long"), 0
    for place, width in order:
        part = F.shiftrightunsigned(F.shiftleft(fp, place), 64 - width) if width < 64 else fp
        out = out.bitwiseOR(F.shiftleft(part, 64 - at - width))
        at += width
    return out


def _gray_ranked(rows: DataFrame, code: str) -> DataFrame:
    """The rows with the place of their 64-bit word in the order of the reflected Gray code, as `rank`.

    Each step uses the one before twice, so each is a projection of its own.
    """
    rows = rows.withColumnRenamed(code, "rank")
    for k in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", k)))
    return rows


class Forest:
    """Components of numbered items, joined by lists of links."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        label = self.label
        while len(left):
            a, b = label[left], label[right]
            open_ = a != b
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                next_ = label[label]
                if (next_ == label).all():
                    break
                label[:] = next_


def linked(codes: np.ndarray, segment: np.ndarray, most: int) -> np.ndarray:
    """Component label (smallest place) of each code; codes of one segment link if they differ in at most `most` bits.

    `codes` are unsigned and sorted by segment and Gray rank.
    """
    size = len(codes)
    forest = Forest(size)
    begin = np.concatenate([np.arange(size), [size]])
    levels = [(codes, np.full(size, ~np.uint64(0)), begin, begin)]  # pattern, mask, first leaf, first child
    owner = segment
    while True:
        pattern, mask, leaf, _ = levels[-1]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        if first.all():
            break
        number = np.arange(len(owner))
        rank = number - np.maximum.accumulate(np.where(first, number, 0))
        cut = np.flatnonzero(rank % _FANOUT == 0)
        low, high = np.bitwise_and.reduceat(pattern, cut), np.bitwise_or.reduceat(pattern, cut)
        shared = np.bitwise_and.reduceat(mask, cut) & ~(low ^ high)
        levels.append((low & shared, shared, np.append(leaf[cut], size), np.append(cut, len(owner))))
        owner = owner[cut]
    top = np.arange(len(owner))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, left, right = stack.pop()
        if len(left) > _PAIRS:
            stack.append((level, left[_PAIRS:], right[_PAIRS:]))
            left, right = left[:_PAIRS], right[:_PAIRS]
        pattern, mask, leaf, child = levels[level]
        both = mask[left] & mask[right]
        differ = np.bitwise_count((pattern[left] ^ pattern[right]) & both)
        open_ = differ <= most
        if level:
            # nodes whose leaves are all in one component, the same for both, hold no new link
            smallest = np.minimum.reduceat(forest.label, leaf[:-1])
            largest = np.maximum.reduceat(forest.label, leaf[:-1])
            same = (smallest[left] == largest[left]) & (smallest[right] == largest[right]) & (smallest[left] == smallest[right])
            open_ &= ~same
        left, right, both, differ = left[open_], right[open_], both[open_], differ[open_]
        if not level:
            forest.join(left, right)
            continue
        sure = differ + np.bitwise_count(~both) <= most
        if sure.any():
            for node in (left[sure], right[sure]):
                count = leaf[node + 1] - leaf[node]
                to = np.repeat(leaf[left[sure]], count)
                own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(leaf[node], count)
                forest.join(own, to)
            left, right = left[~sure], right[~sure]
        if len(left):
            rows, columns = child[left + 1] - child[left], child[right + 1] - child[right]
            count = rows * columns
            step = max(_PAIRS // (_FANOUT * _FANOUT), 1)
            for k in range(0, len(left), step):
                s = slice(k, k + step)
                n = count[s]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(columns[s], n)
                a = np.repeat(child[left[s]], n) + inside // width
                b = np.repeat(child[right[s]], n) + inside % width
                ordered = (a < b) | ((a == b) & (level > 1))
                keep = ordered | (np.repeat(left[s] != right[s], n))
                stack.append((level - 1, a[keep], b[keep]))
    return forest.label


_STAR = {"a": pa.int64(), "b": pa.int64()}


def _linker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def stars(rows: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate([[0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))])
            rank = rows[:, 3].view(np.uint64)
            label = linked(rank ^ (rank >> np.uint64(1)), group, most)
            own = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[own, 4]), pa.array(rows[label[own], 4])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.ascontiguousarray(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key", "cell", "rank", "fp")]))
            held.append(rows)
            size += len(rows)
            if size >= _BLOCK:
                rows = np.concatenate(held)
                # the last group may go on in the next batch
                last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield stars(np.ascontiguousarray(rows[:cut]))
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield stars(np.ascontiguousarray(np.concatenate(held)))

    return run


def links(codes: DataFrame, most: int = 3, blocks: int | None = None, max_group: int = 100_000) -> DataFrame:
    """(a, b): links between the distinct fingerprints `codes` (fp) that connect all that differ in at most `most` bits.

    `blocks` (most + 1 at least) is the number of blocks; with more, more of them must agree, for every choice of them, which
    makes groups smaller and copies of rows more. Groups above `max_group` are dealt into parts by hash, and every two parts meet in a
    cell of their own; nothing is left out.
    """
    blocks = blocks or most + 1
    if not most < blocks <= 64:
        raise ValueError("blocks must be above the number of bits that may differ")
    places = _bits(blocks)
    tables = []
    for number, lead in enumerate(combinations(range(blocks), blocks - most)):
        order = [places[k] for k in (*lead, *(k for k in range(blocks) if k not in lead))]
        width = sum(places[k][1] for k in lead)
        tables.append(F.struct(F.lit(number).cast("long").alias("table"), F.lit(64 - width).alias("rest"), _turned(F.col("fp"), order).alias("code")))
    rows = _gray_ranked(codes.select("fp", F.inline(F.array(*tables))), "code")
    rows = rows.select("fp", "table", F.expr("shiftrightunsigned(rank, rest)").alias("key"), "rank")
    large = materialize(rows.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_group), "simhash-groups")
    parts = F.coalesce(F.ceil(F.col("n") / max_group), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.least(F.col("own"), other) * F.col("parts") + F.greatest(F.col("own"), other))
    dealt = rows.join(large, ["table", "key"], "left").withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.select("table", "key", F.explode(meet).alias("cell"), "rank", "fp")
    grouped = dealt.repartition("table", "key", "cell").sortWithinPartitions("table", "key", "cell", "rank")
    return grouped.mapInArrow(_linker(most), "a bigint, b bigint")


def _classes(made: DataFrame, key: str, most: int, blocks: int | None, max_group: int) -> DataFrame:
    """(fp, least): for every distinct fingerprint of `made` the least `key` of its component, null keys only if there is no other."""
    codes = materialize(made.groupBy("fp").agg(F.min(key).alias("low")), "simhash-codes")
    nodes = components(links(codes.select("fp"), most, blocks, max_group)).select(F.col("node").alias("fp"), "root")
    members = materialize(codes.join(nodes, "fp"), "simhash-members")
    lows = members.groupBy("root").agg(F.min("low").alias("least"))
    joined = members.join(lows, "root").select("fp", "least")
    return codes.join(joined.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, most: int = 3,
                    blocks: int | None = None, max_group: int = 100_000) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id of its component).

    A text of fewer words than a shingle is one shingle; a null text or one without a word has fingerprint zero, which
    links like any other. Rows with null id belong to components but name none (null where there is no other). Repeated
    ids and rows keep their rows; an empty table gives an empty result; other columns are not read.
    """
    made = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    classes = _classes(made, "id", most, blocks, max_group)
    return made.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, most: int = 3,
             blocks: int | None = None, max_group: int = 100_000) -> DataFrame:
    """One row of `docs`, all columns, for each component of `near_duplicates`: one with the smallest id.

    Rows with null id come after all others; of rows with the same id the one with the smallest hash of its text stays, and of
    rows that agree in both any one.
    """
    row = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias("h"))
    made = materialize(fingerprints(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", words_per_shingle).withColumnRenamed("id", "row"), "simhash")
    chosen = _classes(made, "row", most, blocks, max_group).groupBy("least").agg(F.count("*").alias("n"))
    pair = [F.xxhash64(F.lit(k), "row").alias(f"r{k}") for k in (1, 2)]
    wanted = chosen.select(F.col("least").alias("row")).select(*pair)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("row")).select("doc", *pair)
    kept = packed.join(wanted, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
