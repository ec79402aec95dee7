"""Operator 7, benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (`min_tile` words in a row, or all words of a shorter item) are candidates. If the shared seeds could
cover enough of the item, both are tiled: the longest common runs of unmarked words are found by running Karp-Rabin
with a falling search length, and marked one after the other, so that tiles do not overlap and may come in any order. The
item leaks if its tiles cover at least `coverage` of its words, also when passages were put in another order.

The benchmark is the stated query set. Its distinct texts are taken in blocks of bounded size; each block goes to the tasks,
which search all documents where they are read, and what they find is written before the next block is read. Documents are
not shuffled for the search; ids of items, and of several blocks the verdicts, are joined by two 64-bit hashes of the text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import text_blocks, texts_of
from cohortlens.session import materialize, scratch_dir

_WORD = re.compile(r"\w+")
_FACTOR = 1_000_003


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` codes."""
    out = np.zeros(max(len(codes) - length + 1, 0), np.uint64)
    for k in range(length):
        out = out * np.uint64(_FACTOR) + codes[k:k + len(out)].astype(np.uint64)
    return out


def tile(item: list[int], text: list[int], min_tile: int, first_length: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in text, length) of at least `min_tile` codes, longest first.

    Negative codes match nothing. Of equally long matches the first in the item, then in the text, is marked first.
    """
    used_item, used_text = [c < 0 for c in item], [c < 0 for c in text]
    found: list[tuple[int, int, int]] = []

    def search(length: int) -> list[tuple[int, int, int]]:
        """Common unmarked runs of at least `length`, as long as they go, that do not begin inside another one."""
        places = defaultdict(list)
        for t, h in _open_hashes(text, used_text, length):
            places[h].append(t)
        matches = []
        for p, h in _open_hashes(item, used_item, length):
            for t in places.get(h, ()):
                if p and t and item[p - 1] == text[t - 1] and not used_item[p - 1] and not used_text[t - 1]:
                    continue
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not used_item[p + k] and not used_text[t + k]:
                    k += 1
                if k >= length:
                    matches.append((k, p, t))
        return matches

    length = max(min(first_length, len(item)), min_tile)
    while True:
        matches = search(length)
        longest = max((m[0] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        while matches:
            matches.sort(key=lambda m: (-m[0], m[1], m[2]))
            rest = []
            for k, p, t in matches:
                free = [not used_item[p + j] and not used_text[t + j] for j in range(k)]
                if all(free):
                    used_item[p:p + k] = [True] * k
                    used_text[t:t + k] = [True] * k
                    found.append((p, t, k))
                    continue
                # what earlier tiles have left of this match takes its turn by its own length
                begin = None
                for j, ok in enumerate([*free, False]):
                    if ok and begin is None:
                        begin = j
                    elif not ok and begin is not None:
                        if j - begin >= length:
                            rest.append((j - begin, p + begin, t + begin))
                        begin = None
            matches = rest
        if length <= min_tile:
            return found
        length = max(length // 2, min_tile)


def _open_hashes(codes: list[int], used: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Places and hashes of the unmarked runs of `length`."""
    if len(codes) < length:
        return
    marked = np.concatenate([[0], np.cumsum(used)])
    free = np.flatnonzero(marked[length:] == marked[:-length])
    hashes = _rolling(np.array(codes, np.int64), length)
    yield from zip(free.tolist(), hashes[free].tolist())


class Items:
    """One block of the benchmark: vocabulary, item codes, and the items of every seed."""

    def __init__(self, rows: list[tuple[object, str]], min_tile: int, coverage: float):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.ids = [r[0] for r in rows]
        self.codes = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(r[1])] for r in rows]
        owners: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, codes in enumerate(self.codes):
            length = min(min_tile, len(codes))  # an item of fewer words is a seed as a whole
            for place, h in enumerate(_rolling(np.array(codes, np.int64), length).tolist() if length else ()):
                owners[length][h].append((number, place))
        self.owners = {length: dict(own) for length, own in owners.items()}
        self.seeds = {length: np.array(sorted(own), np.uint64) for length, own in self.owners.items()}

    def search(self, text: str) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Numbers of the items that leak into the text, each with its tiles."""
        get = self.vocabulary.get
        codes = np.array([get(w, -1) for w in words(text)], np.int64)
        known = np.concatenate([[0], np.cumsum(codes < 0)])
        return sorted((found for length in self.seeds for found in self._search(codes, known, length)), key=lambda f: f[0])

    def _search(self, codes: np.ndarray, known: np.ndarray, length: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The leaks of the items whose seeds have `length` words."""
        seeds, owners = self.seeds[length], self.owners[length]
        if len(codes) < length:
            return []
        runs = np.flatnonzero(known[length:] == known[:-length])
        if not len(runs):
            return []
        hashes = _rolling(codes, length)[runs]
        at = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
        hit = seeds[at] == hashes
        runs, hashes = runs[hit].tolist(), hashes[hit].tolist()
        covered: dict[int, set[int]] = defaultdict(set)
        shared: dict[int, set[int]] = defaultdict(set)
        for h in set(hashes):
            for number, place in owners[h]:
                covered[number].update(range(place, place + length))
                shared[number].add(h)
        out, joined = [], {}
        for number in sorted(covered):
            item = self.codes[number]
            if len(covered[number]) < self.coverage * len(item):
                continue  # no tiling can cover more than the shared seeds do
            own = frozenset(shared[number])
            # items that share the same seeds with the text, as those with a common preamble do, see the same part of it
            if own not in joined:
                joined[own] = self._near(codes, runs, hashes, own, length)
            near, places = joined[own]
            tiles = [(p, places[t], k) for p, t, k in tile(item, near, length)]
            if sum(k for _, _, k in tiles) >= self.coverage * len(item):
                out.append((number, tiles))
        return out

    @staticmethod
    def _near(codes: np.ndarray, runs: list[int], hashes: list[int], own: frozenset, length: int) -> tuple[list[int], list[int]]:
        """The words of the text in some of its seeds and their places, with -1 for what lies between."""
        near, last = [], -1
        places: list[int] = []
        for place, h in zip(runs, hashes):
            if h in own:
                if last >= 0 and place > last:
                    near.append(-1)
                    places.append(-1)
                new = range(max(place, last), place + length)
                near.extend(codes[new.start:new.stop].tolist())
                places.extend(new)
                last = place + length
        return near, places


def _dealt(benchmark: DataFrame, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct texts of the benchmark with their keys, written once, and the number of blocks of about `block_bytes`."""
    texts = materialize(benchmark.select(F.col(text_col).alias("text")).where("text <> ''").distinct().select("text", *_keys(F.col("text"))), "benchmark-texts")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return texts, max(1, math.ceil(total / block_bytes))


def _keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for the text."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _items(texts: DataFrame, count: int, k: int, min_tile: int, coverage: float) -> Items:
    part = texts.where(F.pmod("k1", F.lit(count)) == k)
    return Items(sorted(((r["k1"], r["k2"]), r["text"]) for r in part.collect()), min_tile, coverage)


def _written(rows: DataFrame, search: Callable[[Items], Callable], schema: str, purpose: str, texts: DataFrame, count: int, min_tile: int, coverage: float) -> DataFrame:
    """What `search` finds in the rows, of one block after the other; the driver lets go of a block before it reads the next."""
    path = scratch_dir(rows.sparkSession, purpose)
    for k in range(count):
        rows.mapInArrow(search(_items(texts, count, k, min_tile, coverage)), schema).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


_TILES = "array<struct<item_start:int,doc_start:int,length:int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", min_tile: int = 5, coverage: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per leaking pair: id, item id, n_words (of the item), n_covered, coverage, contaminated (true), tiles.

    Words are lower-cased runs of letters, digits and underscores; tiles are given in words. An item of fewer than
    `min_tile` words leaks where it stands as a whole; an item without words never does; null texts have no word. Null and repeated ids and repeated rows each
    give their own pairs; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, k1 bigint, k2 bigint, n_words int, n_covered int, tiles {_TILES}"
    texts, count = _dealt(benchmark, item_text_col, block_bytes)
    if count == 1:
        found = rows.mapInArrow(_pairs(_items(texts, 1, 0, min_tile, coverage)), schema)
    else:
        found = _written(rows, _pairs, schema, "benchmark-pairs", texts, count, min_tile, coverage)
    # rows that repeat a text are searched for once
    out = found.join(benchmark.select(F.col(item_col).alias("item"), *_keys(F.col(item_text_col))), ["k1", "k2"])
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_words", "n_covered",
        (F.col("n_covered") / F.col("n_words")).alias("coverage"), F.lit(True).alias("contaminated"), "tiles")


def _pairs(items: Items):
    kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            found = [(k, number, tiles) for k, text in enumerate(texts_of(batch, "text")) for number, tiles in items.search(text)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array([f[0] for f in found], pa.int64())),
                pa.array([items.ids[f[1]][0] for f in found], pa.int64()),
                pa.array([items.ids[f[1]][1] for f in found], pa.int64()),
                pa.array([len(items.codes[f[1]]) for f in found], pa.int32()),
                pa.array([sum(t[2] for t in f[2]) for f in found], pa.int32()),
                pa.array([[dict(zip(("item_start", "doc_start", "length"), t)) for t in f[2]] for f in found], kind),
            ], names=["id", "k1", "k2", "n_words", "n_covered", "tiles"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          min_tile: int = 5, coverage: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of `docs`, all columns, without those into which an item leaks; the rules are those of `leaks`."""
    texts, count = _dealt(benchmark, item_text_col, block_bytes)
    if count == 1:
        return docs.mapInArrow(_clean(_items(texts, 1, 0, min_tile, coverage), text_col), docs.schema)
    rows = docs.select(F.col(text_col).alias("text"), *_keys(F.col(text_col)))
    leaking = _written(rows, _leaking, "k1 bigint, k2 bigint", "benchmark-leaks", texts, count, min_tile, coverage).distinct()
    own = _keys(F.col(f"d.{text_col}"))
    return docs.alias("d").join(leaking.alias("l"), (own[0] == F.col("l.k1")) & (own[1] == F.col("l.k2")), "left_anti")


def _clean(items: Items, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text_col, 4 << 20):
            yield batch.filter(pa.array([not items.search(t) for t in texts_of(batch, text_col)], pa.bool_()))

    return run


def _leaking(items: Items):
    """Keys of the texts into which an item of the block leaks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            yield batch.filter(pa.array([bool(items.search(t)) for t in texts_of(batch, "text")], pa.bool_())).select(["k1", "k2"])

    return run
