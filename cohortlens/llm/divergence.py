"""Operator 11, source divergence audit with dominance skybands.

Terms are counted by language and source in tasks and summed; a language keeps the terms of at least `min_docs` of its
documents. A group is a language and a source. Every kept term has an integer share p in each group and q in its language,
1 + floor(unit * (count + 1) / (N + V)) with N the sum of its V counts, and a divergence floor((p - q)^2 / q).

Part `term`, the terms that stand out most in a group. The divergence of a term with p > q rises with its count in the group and
falls with its count in the language, and ties go to the term that is earlier in UTF-8. So a term that k others dominate (group
count not lower, language count not higher, earlier) is not among the first k. Each partition keeps the terms of a group
that fewer than k others dominate (the skyband), skybands are merged, first by some tasks a group, and only what is left is
ranked, by exact value.

Part `pair`, how far a source is from each other source of its language, summed over all kept terms. Sources are dealt into
tiles and terms into buckets; a task takes the counts of two tiles and one bucket as a matrix. Terms that neither
tile has are counted, not listed: they all have the same divergence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import batch_of
from cohortlens.session import materialize

#: Bytes of terms; A-Z are lower-cased, all others separate terms (fixed rule).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PIECE = 4 << 20
_HELD = 400_000  # distinct (group, term) counts that a task holds before it passes them on

_COUNT = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}
_POINT = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "total": pa.int64(), "p": pa.int64(), "q": pa.int64()}
_TILE = {"lang": pa.string(), "a": pa.int64(), "b": pa.int64(), "value": pa.int64(), "seen": pa.int64()}


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists of the terms of about 4 MB."""
    data = (text or "").encode().translate(_FOLD)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + _PIECE)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a term may come several times."""
    said: dict[tuple, Counter] = {}  # occurrences by group
    held: dict[tuple, Counter] = {}  # documents by group

    def made():
        for (lang, source), counts in said.items():
            terms, docs = list(counts), held[lang, source]
            yield batch_of(
                _COUNT, lang=[lang] * len(terms), source=[source] * len(terms), term=pa.array(terms, pa.binary()).cast(pa.string()),
                n=list(counts.values()), docs=[docs[t] for t in terms])
        said.clear()
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts, docs = said.setdefault((lang, source), Counter()), held.setdefault((lang, source), Counter())
            size -= len(counts)
            own: set[bytes] = set()
            for terms in term_pieces(text):
                counts.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(counts)
            if size >= _HELD:
                yield from made()
                size = 0
    yield from made()


def skyband(n: np.ndarray, total: np.ndarray, place: np.ndarray, keep: int, block: int = 512) -> np.ndarray:
    """Positions of the points that fewer than `keep` others dominate: n not lower, total not higher, place lower.

    A point that `keep` others dominate is also dominated by `keep` points of the skyband, so each is compared with those only.
    Every dominator comes before its points in the order of n, total, place.
    """
    order = np.lexsort((place, total, -n))
    band = np.zeros(0, np.int64)
    for start in range(0, len(order), block):
        new = order[start:start + block]
        count = ((total[band][:, None] <= total[new]) & (place[band][:, None] < place[new])).sum(0)
        new, count = new[count < keep], count[count < keep]
        if len(new):
            before = np.tri(len(new), k=-1, dtype=bool).T  # [dominator, point]
            inside = before & (total[new][:, None] <= total[new]) & (place[new][:, None] < place[new])
            band = np.concatenate([band, new[count + inside.sum(0) < keep]])
    return band


def _skybands(keep: int):
    """The skyband of each group among the rows of a task."""

    def pruned(rows: list[tuple]) -> list[tuple]:
        terms, n, total, _, _ = zip(*rows)
        place = np.empty(len(rows), np.int64)
        place[sorted(range(len(rows)), key=terms.__getitem__)] = np.arange(len(rows))
        return [rows[k] for k in skyband(np.array(n), np.array(total), place, keep).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}
        limit: dict[tuple, int] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _POINT]
            for lang, source, term, *numbers in zip(*columns):
                rows = held.setdefault((lang, source), [])
                rows.append((term.encode(), *numbers))
                if len(rows) >= limit.get((lang, source), 32 * keep):
                    rows[:] = pruned(rows)
                    limit[(lang, source)] = max(32 * keep, 4 * len(rows))
        for (lang, source), rows in held.items():
            terms, *numbers = zip(*pruned(rows))
            yield batch_of(_POINT, lang=[lang] * len(terms), source=[source] * len(terms), term=[t.decode() for t in terms], **dict(zip("n total p q".split(), numbers)))

    return run


def _share(count: Column, size: Column, unit: int) -> Column:
    """1 + floor(unit * (count + 1) / size) in exact whole numbers."""
    scaled = F.lit(unit).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
    return F.lit(1).cast("bigint") + F.call_function("div", scaled, size.cast("decimal(20,0)"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _tile_sums(group: pa.Table) -> pa.Table:
    """Divergences between the sources of two tiles, summed over the terms of a bucket that one of them has."""
    first, second, lang = (group.column(c)[0].as_py() for c in ("ta", "tb", "lang"))
    numbers, own = np.unique(group.column("no").to_numpy(), return_inverse=True)
    tiles, without = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    tiles[own], without[own] = group.column("tile").to_numpy(), group.column("p0").to_numpy()
    terms = group.column("term").combine_chunks().dictionary_encode()
    known = terms.is_valid().to_numpy(zero_copy_only=False)
    code = terms.indices.fill_null(0).to_numpy()
    shares = np.tile(without, (len(terms.dictionary), 1))
    shares[code[known], own[known]] = group.column("p").to_numpy()[known]
    out = []
    for a in np.flatnonzero(tiles == first):
        # inside a tile each pair is met once
        others = np.flatnonzero((tiles == second) & ((first != second) | (np.arange(len(tiles)) > a)))
        p, q = shares[:, [a]], shares[:, others]
        apart = (p - q) ** 2
        here = np.full(len(others), numbers[a])
        out.append((here, numbers[others], (apart // q).sum(0)))
        out.append((numbers[others], here, (apart // p).sum(0)))
    a, b, value = (np.concatenate(c) for c in zip(*out)) if out else np.zeros((3, 0), np.int64)
    return pa.Table.from_batches([batch_of(
        _TILE, lang=pa.array([lang] * len(a), pa.string()), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()), value=pa.array(value, pa.int64()),
        seen=pa.array(np.full(len(a), len(shares)), pa.int64()))])


def _pairs(cells: DataFrame, groups: DataFrame, tile: int, bucket: int) -> DataFrame:
    """(lang, source, item, value) of every source with each other one of its language."""
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / bucket)).cast("bigint")
    tiles = F.ceil(F.col("sources") / tile).cast("bigint")
    columns = ["lang", "no", "p0", "term", "p", "bucket", tiles.alias("tiles")]
    listed = cells.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets)).select(columns)
    # every bucket knows every source, also one without any of its terms
    empty = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1)))
    empty = empty.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p0")).select(columns)
    every = listed.unionByName(empty).withColumn("tile", F.floor(F.col("no") / tile)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    met = every.select("lang", "no", "p0", "term", "p", "bucket", "tile", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"))
    sums = met.groupBy("lang", "bucket", "ta", "tb").applyInArrow(_tile_sums, "lang string, a bigint, b bigint, value bigint, seen bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = {k: groups.select("lang", F.col("no").alias(k), F.col("source").alias(f"source_{k}"), F.col("p0").alias(f"p_{k}")) for k in "ab"}
    joined = sums.join(side["a"], ["lang", "a"]).join(side["b"].join(groups.select("lang", F.col("no").alias("b"), "v"), ["lang", "b"]), ["lang", "b"])
    rest = (F.col("v") - F.col("seen")) * _divergence(F.col("p_a"), F.col("p_b"))
    return joined.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), (F.col("value") + rest).alias("value"))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200,
          unit: int = 1_000_000_000, tile: int = 64, bucket: int = 4096, mergers: int = 8) -> DataFrame:
    """Rows lang, source, part, item, value, rank: what sets each group of documents apart, rank from 1.

    Part `term`: the first `top` terms of the group with a larger share in it than in its language. Part `pair`: every
    other source of the language. Order: value descending, then item by UTF-8. Terms are runs of letters A-Z, a-z and of all
    characters beyond ASCII; only A-Z are lower-cased.

    Null text, language and source count as empty; an empty language or source is one like any other. A group without any
    term has its pairs. A language that keeps no term has pairs of value 0 and no term. Repeated rows are documents
    of their own; ties are ranked by item. Texts of any length are read piece by piece. An empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counted = rows.mapInArrow(_counter, "lang string, source string, term string, n bigint, docs bigint")
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = materialize(kept, "divergence-kept")
    points = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-points")
    none = F.lit(0).cast("bigint")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    by_group = points.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = rows.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("own", "v", "all")])
    in_lang = Window.partitionBy("lang")
    size, whole = F.col("own") + F.col("v"), F.col("all") + F.col("v")
    groups = groups.select(
        "lang", "source", "v", size.alias("size"), whole.alias("whole"), F.coalesce(_share(none, F.nullif(size, none), unit), F.lit(1).cast("bigint")).alias("p0"),
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("bigint").alias("no"), F.count("*").over(in_lang).alias("sources"))
    groups = materialize(groups, "divergence-groups")
    cells = points.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("size"), unit)).withColumn("q", _share(F.col("total"), F.col("whole"), unit))
    cells = materialize(cells, "divergence-shares")
    columns = list(_POINT)
    kind = "lang string, source string, term string, n bigint, total bigint, p bigint, q bigint"
    local = cells.where("p > q").select(columns).mapInArrow(_skybands(top), kind)
    salted = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(mergers)))
    merged = salted.mapInArrow(_skybands(top), kind).select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(merged, "term").where(F.col("rank") <= top).unionByName(_ranked(_pairs(cells, groups, tile, bucket), "pair"))
