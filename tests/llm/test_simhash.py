import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import simhash as S
from cohortlens.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, most=3):
    codes = np.array(codes, np.uint64)
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= most)
            least = min(label[j] for j in near)
            changed |= least < label[i]
            label[i] = least
    return label


def gray_sorted(codes, segment):
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return np.lexsort((rank, segment))


def test_index_finds_the_components_of_each_segment():
    rng = np.random.default_rng(5)
    for _ in range(20):
        seeds = rng.integers(0, 2 ** 63, int(rng.integers(1, 12)), dtype=np.uint64)
        flips = [seeds ^ (np.uint64(1) << rng.integers(0, 64, len(seeds)).astype(np.uint64)) for _ in range(12)]
        codes = np.unique(np.concatenate([seeds, *flips, *[f ^ np.roll(f, 1) ^ np.roll(seeds, 1) for f in flips]]))
        segment = np.sort(rng.integers(0, 3, len(codes)))
        order = gray_sorted(codes, segment)
        codes, segment = codes[order], segment[order]
        found = S.linked(codes, segment, 3)
        for s in range(3):
            own = np.flatnonzero(segment == s)
            assert (found[own] - (own[0] if len(own) else 0)).tolist() == plain_components(codes[own])


def test_a_dense_ball_is_one_component_without_all_pairs():
    rng = np.random.default_rng(6)
    codes = np.unique(np.uint64(12345) ^ np.bitwise_or(*[np.uint64(1) << rng.integers(0, 64, 6000).astype(np.uint64) for _ in range(2)]))
    codes = codes[gray_sorted(codes, np.zeros(len(codes)))]
    assert set(S.linked(codes, np.zeros(len(codes), int), 3).tolist()) == {0}


def test_components_of_chains_stars_and_repeated_links(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 6), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 150)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints_and_components_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    codes = [plain_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    group = plain_components(codes)
    least = {g: min(i for i, h in zip(ids, group) if h == g) for g in set(group)}
    expected = {i: (f"{c:016x}", least[g]) for i, c, g in zip(ids, codes, group)}
    assert len(set(least)) < len(ids)
    for options in ({}, {"blocks": 6}, {"max_group": 2}):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs, **options).collect()}
        assert got == expected
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_hash_is_the_one_of_spark(spark):
    text = "straße 中文 " * 9
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2 ** 64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_messy_rows(messy):
    rows = S.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert of[1][0].fingerprint == of[2][0].fingerprint == of[3][0].fingerprint == "0" * 16
    assert of[1][0].component_id == of[3][0].component_id == 1
    assert [r.component_id for r in of[4]] == [4, 4] and of[6][0].component_id == 5
    assert {r.component_id for r in of[None]} == {None, 1}
    kept = S.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7, 8, 9] and kept.where("doc_id IS NULL").count() == 1
    assert S.near_duplicates(messy.limit(0)).count() == 0 and S.keep_one(messy.limit(0)).count() == 0
