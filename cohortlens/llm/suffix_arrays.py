"""Operator 12, removal of repeated byte strings by prefix-free parsing.

A string of `length` bytes that starts in two places repeats; every byte that such a string covers goes. The order of all
suffixes would show the repeats as neighbours, and prefix-free parsing builds that order from two small ones:

1. A rolling hash of `TRIGGER` bytes picks triggers, about one in `modulus` places. Equal bytes have equal triggers. A phrase reaches
   from a trigger to the end of the next one. No phrase suffix is the beginning of another, so suffixes of the corpus
   compare by the suffix of the phrase they begin in, then by the phrases that follow.
2. Phrases are counted over all texts. A string that repeats has only repeating phrases inside, so only places
   whose following `length` bytes have no unique phrase stay in (`open_windows`). In ordinary text that is next to nothing.
3. What is left is cut into forms: the places before one trigger, up to the trigger before it, with the bytes that they
   reach. A form is a run of suffixes of one phrase together with the parse that follows. Equal forms are counted; all
   their places repeat. Forms that stand alone but share their first whole phrase with others go on.
4. For these, by that phrase: the bytes behind the trigger are sorted (the order of the parse, with the lengths that neighbours
   share); the bytes before it are ranked suffix by suffix (the order of the dictionary). Places that
   begin in the same dictionary suffix, taken in the order of the parse, are neighbours in the order of the corpus; those that share
   `length` bytes with a neighbour repeat.

A place without a trigger in reach is cut at its least hash instead and goes the same way. A phrase with more than `group` forms is
not sorted in one task: its places are counted one by one, by the hash of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import text_blocks
from cohortlens.session import discard, materialize

TRIGGER = 16
_PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)

_FORM = {"s": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "t": pa.int64(), "first": pa.int64(), "n": pa.int64(), "lead": pa.int64()}
_FORM_SQL = ", ".join(f"{c} bigint" for c in _FORM)
_KEY = ["s", "k1", "k2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of TRIGGER bytes."""
    out, size = _CODES[data], 1
    while size < TRIGGER:
        out = out[:-size] + out[size:] * np.uint64(pow(_FACTOR, size, 1 << 64))
        size *= 2
    return _mixed(out)


def triggers(data: bytes, modulus: int) -> np.ndarray:
    """Places at which a run of TRIGGER bytes begins whose hash is a multiple of `modulus`; read piece by piece."""
    found = [np.zeros(0, np.int64)]
    for begin in range(0, len(data) - TRIGGER + 1, _PIECE):
        piece = np.frombuffer(data, np.uint8, min(_PIECE + TRIGGER - 1, len(data) - begin), begin)
        found.append(np.flatnonzero(rolling(piece) % np.uint64(modulus) == 0) + begin)
    return np.concatenate(found)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def phrase_hash(data: memoryview, places: np.ndarray) -> np.ndarray:
    """Hashes of the phrases between neighbouring triggers, both triggers included."""
    at = places.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[b:e + TRIGGER]) for b, e in zip(at, at[1:])), np.uint64, max(len(at) - 1, 0)).view(np.int64)


def open_windows(n: int, places: np.ndarray, unique: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of a text of `n` bytes whose next `length` bytes have no unique phrase inside, as runs.

    begin, end, and of each run the numbers of the first trigger at or behind a place and of the last one in its reach;
    a run ends where either changes.
    """
    total = n - length + 1
    edges = np.concatenate([[0], places + 1, places + TRIGGER - length])
    edges = np.unique(edges[(edges >= 0) & (edges < total)])
    first = np.searchsorted(places, edges, "left")
    last = np.searchsorted(places, edges + length - TRIGGER, "right") - 1
    before = np.concatenate([[0], np.cumsum(unique)])
    inside = last > first
    fits = ~inside
    fits[inside] = before[last[inside]] == before[first[inside]]
    return edges[fits], np.append(edges[1:], total)[fits], first[fits], last[fits]


def _least(values: np.ndarray, length: int) -> np.ndarray:
    size, power = 1, values
    while 2 * size <= length:
        power = np.minimum(power[:len(power) - size], power[size:])
        size *= 2
    rest = length - size
    return np.minimum(power[:len(power) - rest], power[rest:]) if rest else power


def _without_trigger(data: bytes, begin: int, end: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Forms (first, end, anchor, hash) of a run of places that reach no trigger: the anchor is the first least hash in reach."""
    for b in range(begin, end, _PIECE):
        e = min(b + _PIECE, end)
        hashes = rolling(np.frombuffer(data, np.uint8, e - b + length - 1, b))
        ranked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(ranked, length - TRIGGER + 1) & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(anchor)]):
            a = int(anchor[x])
            yield b + x, b + y, b + a, int(hashes[a])


def forms(data: bytes, runs: list[dict], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Forms (key, first, places, lead) of the open runs of a text; lead is the number of bytes before the anchor at `first`.

    A run has begin, end, its anchor (-1 where no trigger is in reach) and `upto`, the trigger that ends the whole phrase
    behind the anchor, or the anchor where there is no whole phrase in reach.
    """
    view = memoryview(data)
    held = None  # the run before, if the next one may continue it
    for run in [*runs, None]:
        if run is None:
            nexts = [None]
        elif run["anchor"] < 0:
            nexts = list(_without_trigger(data, run["begin"], run["end"], length))
        else:
            nexts = [(run["begin"], run["end"], run["anchor"], (run["upto"],))]
        for new in nexts:
            if held and new and held[1] == new[0] and held[2:] == new[2:]:
                held = (held[0], *new[1:])
                continue
            if held:
                begin, end, anchor, kind = held
                key = kind if isinstance(kind, int) else xxhash.xxh3_64_intdigest(view[anchor:kind[0] + TRIGGER], seed=1 + (kind[0] > anchor))
                yield _signed(key), begin, end - begin, anchor - begin
            held = new


def _parse(length: int, modulus: int):
    """(t, phrases, loose) of each text; loose if some place reaches no whole phrase, so that no phrase speaks for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            phrases, loose = [], []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                at = triggers(data, modulus)
                found = phrase_hash(memoryview(data), at)
                phrases.append(found)
                loose.append(len(open_windows(len(data), at, np.ones(len(found), bool), length)[0]) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(phrases, pa.list_(pa.int64())), pa.array(loose, pa.bool_())], names=["t", "phrases", "loose"])

    return run


_RUN = pa.struct([(c, pa.int32()) for c in ("begin", "end", "anchor", "upto")])
_RUN_SQL = "t bigint, text string, runs array<struct<begin:int,end:int,anchor:int,upto:int>>"


def _open(length: int, modulus: int):
    """(t, text, runs) of the texts that have open places, from their recurring phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            kept, lists = [], []
            for k, (text, recurring) in enumerate(zip(batch.column("text").to_pylist(), batch.column("recurring"))):
                data = text.encode()
                places = triggers(data, modulus)
                unique = ~np.isin(phrase_hash(memoryview(data), places), recurring.values.to_numpy())
                begin, end, first, last = open_windows(len(data), places, unique, length)
                if len(begin):
                    after = np.append(places, [-1, -1])
                    anchor = np.where(last < first, -1, after[first])
                    upto = np.where(last > first, after[first + 1], anchor)
                    kept.append(k)
                    lists.append([dict(zip(("begin", "end", "anchor", "upto"), r)) for r in zip(begin.tolist(), end.tolist(), anchor.tolist(), upto.tolist())])
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("t").take(rows), batch.column("text").take(rows), pa.array(lists, pa.list_(_RUN))], names=["t", "text", "runs"])

    return run


def _forms(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            out: dict[str, list] = {c: [] for c in _FORM}
            for t, text, runs in zip(*(batch.column(c).to_pylist() for c in ("t", "text", "runs"))):
                data = text.encode()
                view = memoryview(data)
                for key, first, n, lead in forms(data, runs, length):
                    k = xxhash.xxh3_128_intdigest(view[first:first + n - 1 + length], seed=lead)
                    for c, value in zip(_FORM, (key, _signed(k >> 64), _signed(k & ((1 << 64) - 1)), t, first, n, lead)):
                        out[c].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in _FORM.items()], names=list(_FORM))

    return run


def _content(length: int):
    """(s, k1, k2, times, lead, hot, content) of the wanted forms of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {**dict.fromkeys(("s", "k1", "k2", "times", "lead"), pa.int64()), "hot": pa.bool_(), "content": pa.binary()}
        names = list(kinds)
        for batch in text_blocks(batches, "text", 1 << 20):
            out: dict[str, list] = {c: [] for c in names}
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for w in wanted:
                    for c in names[:-1]:
                        out[c].append(w[c])
                    out["content"].append(data[w["first"]:w["first"] + w["n"] - 1 + length])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], names=names)

    return run


def repeated_places(keys: list, content: list[bytes], lead: list[int], length: int) -> list[np.ndarray]:
    """For each of the distinct forms the places, by their distance to the anchor, that repeat in another form with its key.

    The order of the corpus is that of the dictionary suffixes (`group`, ranked one byte at a time from the anchor
    backwards), and inside one suffix that of the parse (`rank`).
    """
    n = len(keys)
    heads = [c[:k] for c, k in zip(content, lead)]
    tails = [c[k:] for c, k in zip(content, lead)]
    # order of the parse, with the number of bytes that neighbours share
    order = sorted(range(n), key=lambda k: (keys[k], tails[k]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    wide = max(map(len, tails), default=0)
    sizes = np.array([len(tails[k]) for k in order], np.int64)
    grid = np.frombuffer(b"".join(tails[k].ljust(wide, b"\0") for k in order), np.uint8).reshape(n, wide)
    differ = grid[1:] != grid[:-1]
    shared = np.minimum(np.where(differ.any(1), differ.argmax(1), wide), np.minimum(sizes[1:], sizes[:-1]))
    shared[[keys[a] != keys[b] for a, b in zip(order, order[1:])]] = 0
    table = [shared]  # least of 2^k neighbours
    while 2 << (len(table) - 1) <= len(shared):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def common(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes that the parses of two ranks share."""
        level = np.log2(high - low + 0.5).astype(np.int64)
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k)])
        return out

    most = np.array(lead, np.int64)
    # the nearest place of a form reaches exactly the end of its content
    least = length - np.array([len(t) for t in tails], np.int64)
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    group = np.array([number[k] for k in keys], np.int64)
    active = np.arange(n)
    found: list[list[np.ndarray]] = [[] for _ in range(n)]
    for distance in range(int(most.max(initial=-1)) + 1):
        if distance:
            stays = most[active] >= distance
            active, group = active[stays], group[stays]
            byte = np.fromiter((heads[k][-distance] for k in active.tolist()), np.int64, len(active))
            group = np.unique(group * 256 + byte, return_inverse=True)[1]
        several = np.bincount(group, minlength=1)[group] > 1
        active, group = active[several], group[several]
        if not len(active):
            break
        here = least[active] <= distance
        at, own = active[here], group[here]
        corpus = np.lexsort((rank[at], own))
        at, own = at[corpus], own[corpus]
        same = own[1:] == own[:-1]
        low, high = rank[at[:-1]][same], rank[at[1:]][same]
        meets = np.zeros(len(at) + 1, bool)
        meets[1:-1][same] = common(low, high) >= length - distance
        for k in at[meets[1:] | meets[:-1]].tolist():
            found[k].append(distance)
    return [np.array(f, np.int64) for f in found]


def _ranges(distances: np.ndarray) -> list[dict]:
    """Runs of distances, nearest and farthest."""
    if not len(distances):
        return []
    cut = np.flatnonzero(np.diff(distances) > 1)
    return [{"near": a, "far": b} for a, b in zip(distances[np.append(0, cut + 1)].tolist(), distances[np.append(cut, len(distances) - 1)].tolist())]


_SPANS = pa.list_(pa.struct([("near", pa.int64()), ("far", pa.int64())]))


def _sorted_groups(length: int, block: int = 2048):
    """(s, k1, k2, spans) of single forms that repeat in part; rows come sorted by s."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        keys, k1, k2, times, lead, content = zip(*rows)
        spans = [_ranges(d) for d in repeated_places(list(keys), list(content), list(lead), length)]
        kept = [(s, a, b, x) for s, a, b, n, x in zip(keys, k1, k2, times, spans) if n == 1 and x]
        columns = list(zip(*kept)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), _SPANS))], names=[*_KEY, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("s", "k1", "k2", "times", "lead", "content"))):
                if len(held) >= block and held[-1][0] != row[0]:
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    return run


def _places(length: int):
    """(s, k1, k2, times, distance, h1, h2): every place of a form with the hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "k1", "k2", "times", "distance", "h1", "h2"]
        for batch in text_blocks(batches, "content", 1 << 18):
            rows = []
            for s, k1, k2, times, lead, content in zip(*(batch.column(c).to_pylist() for c in ("s", "k1", "k2", "times", "lead", "content"))):
                for j in range(len(content) - length + 1):
                    h = xxhash.xxh3_128_intdigest(content[j:j + length])
                    rows.append((s, k1, k2, times, lead - j, _signed(h >> 64), _signed(h & ((1 << 64) - 1))))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _remover(with_bytes: bool):
    """Remove the ranges of each text: t, n_removed, n_spans, kept_sha256, and the kept bytes if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            removed, spans, digests, held = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                data, at, gone, runs = text.encode(), 0, 0, 0
                kept, until = [], -1
                for r in sorted(ranges, key=lambda r: r["begin"]):
                    if r["begin"] > until:
                        kept.append(data[at:r["begin"]])
                        runs += 1
                    if r["end"] > until:
                        gone += r["end"] - max(until, r["begin"])
                        at = until = r["end"]
                kept.append(data[at:])
                removed.append(gone)
                spans.append(runs)
                joined = b"".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_bytes:
                    held.append(joined)
            arrays = [batch.column("t"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["t", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                arrays, names = [*arrays, pa.array(held, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _open_texts(texts: DataFrame, length: int, modulus: int) -> DataFrame:
    """(t, text, runs) of the texts with open places."""
    parsed = materialize(texts.mapInArrow(_parse(length, modulus), "t bigint, phrases array<bigint>, loose boolean"), "suffix-parse")
    single = parsed.select("t", F.explode("phrases").alias("phrase"))
    # written, so that a very frequent phrase can be split in the join
    often = materialize(single.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"), "suffix-dictionary")
    none = parsed.where("loose").select("t", F.lit(None).cast("bigint").alias("phrase"))
    marked = single.join(often, "phrase").select("t", "phrase").unionByName(none).groupBy("t").agg(F.collect_set("phrase").alias("recurring"))
    held = materialize(texts.join(marked, "t").select("t", "text", "recurring").mapInArrow(_open(length, modulus), _RUN_SQL), "suffix-open", "zstd")
    discard(parsed, often)
    return held


def repeated_ranges(texts: DataFrame, length: int, modulus: int, group: int) -> DataFrame:
    """(t, ranges): begin and end in bytes of what repeats, for rows (t, text, runs)."""
    placed = materialize(texts.mapInArrow(_forms(length), _FORM_SQL), "suffix-forms")
    first = F.min(F.struct("t", "first", "n", "lead")).alias("at")
    counted = materialize(placed.groupBy(*_KEY).agg(F.count("*").alias("times"), first).select(*_KEY, "times", "at.*"), "suffix-counts")
    mixed = counted.groupBy("s").agg(F.count("*").alias("forms"), F.min("times").alias("least")).where("forms > 1 AND least = 1").select("s", "forms")
    mixed = materialize(mixed, "suffix-mixed")
    some = counted.join(mixed, "s").withColumn("hot", F.col("forms") > group)
    wanted = some.groupBy("t").agg(F.collect_list(F.struct("s", "k1", "k2", "times", "lead", "first", "n", "hot")).alias("wanted"))
    content = texts.select("t", "text").join(wanted, "t").mapInArrow(_content(length), "s bigint, k1 bigint, k2 bigint, times bigint, lead bigint, hot boolean, content binary")
    content = materialize(content, "suffix-content", "zstd")
    spans = "s bigint, k1 bigint, k2 bigint, spans array<struct<near:bigint,far:bigint>>"
    grouped = content.where("NOT hot").repartition("s").sortWithinPartitions("s").mapInArrow(_sorted_groups(length), spans)
    places = content.where("hot").mapInArrow(_places(length), "s bigint, k1 bigint, k2 bigint, times bigint, distance bigint, h1 bigint, h2 bigint")
    places = materialize(places, "suffix-places")
    again = materialize(places.groupBy("s", "h1", "h2").agg(F.sum("times").alias("all")).where("all > 1").drop("all"), "suffix-places-again")
    near = F.struct(F.col("distance").alias("near"), F.col("distance").alias("far"))
    by_place = places.where("times = 1").join(again, ["s", "h1", "h2"]).groupBy(*_KEY).agg(F.collect_list(near).alias("spans"))
    every = counted.where("times > 1").select(*_KEY, F.lit(None).cast("array<struct<near:bigint,far:bigint>>").alias("spans"))
    verdict = materialize(every.unionByName(grouped).unionByName(by_place), "suffix-verdicts")
    discard(content, places, again, counted, mixed)
    begin = F.col("first") + F.col("lead")
    whole = F.array(F.struct(F.col("first").alias("begin"), (F.col("first") + F.col("n") - 1 + length).alias("end")))
    part = F.transform("spans", lambda x: F.struct((begin - x["far"]).alias("begin"), (begin - x["near"] + length).alias("end")))
    hits = placed.join(verdict, _KEY).select("t", F.when(F.col("spans").isNull(), whole).otherwise(part).alias("r"))
    ranges = materialize(hits.groupBy("t").agg(F.flatten(F.collect_list("r")).alias("ranges")), "suffix-ranges")
    discard(placed, verdict)
    return ranges


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, modulus: int = 40, group: int = 512, bytes_too: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and with `bytes_too` also `kept`, the kept bytes.

    A byte (of the text in UTF-8) goes if a string of `length` bytes that covers it starts anywhere else, in another row
    or elsewhere in the same one, overlaps included; all strings are judged on the input. No string goes beyond its text. Kept
    bytes are joined as they are and may end inside a character.

    A null text counts as empty. Texts shorter than `length` stay whole. Rows that repeat a text, with whatever ids, are documents of
    their own, so they go whole if they are long enough. Very long texts are hashed piece by piece. An empty table gives
    an empty result; other columns are not read.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"strings have {2 * TRIGGER} bytes at least")
    # numbers of texts hold for what is written
    rows = docs.select(F.monotonically_increasing_id().alias("t"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(rows, "suffix-texts", "zstd")
    texts = rows.where(F.octet_length("text") >= length).select("t", "text")
    held = _open_texts(texts, length, modulus)
    ranges = repeated_ranges(held, length, modulus, group)
    kept = ", kept binary" * bytes_too
    cut = held.select("t", "text").join(ranges, "t").mapInArrow(_remover(bytes_too), f"t bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept}")
    data = F.encode("text", "UTF-8")
    own = rows.select("t", "id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("sha"), *[data.alias("data")] * bytes_too)
    none = F.lit(0).cast("bigint")
    return own.join(cut, "t", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *[F.coalesce("kept", "data").alias("kept")] * bytes_too)
