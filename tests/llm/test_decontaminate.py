import gc
import random
import weakref

from cohortlens.llm import decontaminate as D

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def plain_tiles(item, text, least):
    """Greedy string tiling as defined: mark the longest common run of unmarked words, again and again."""
    used_p, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] >= 0 and p + k not in used_p and t + k not in used_t:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        if best[0] < least:
            return sum(k for k, _, _ in out), out
        k, p, t = best
        used_p.update(range(p, p + k))
        used_t.update(range(t, t + k))
        out.append(best)


def test_tiles_are_those_of_the_plain_definition():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 25))]
        text = [rng.randrange(-1, 4) for _ in range(rng.randint(0, 40))]
        tiles = D.tile(item, text, 3)
        assert all(item[p:p + k] == text[t:t + k] and k >= 3 for p, t, k in tiles)
        for side in (0, 1):
            places = [x for tile in tiles for x in range(tile[side], tile[side] + tile[2])]
            assert len(places) == len(set(places))
        assert sorted(t[2] for t in tiles)[-1:] == sorted(k for k, _, _ in plain_tiles(item, text, 3)[1])[-1:]


def test_running_search_starts_again_for_very_long_matches():
    run = list(range(200))
    assert D.tile(run, [-1, *run, -1], 5) == [(0, 1, 200)]


def test_reordered_passages_leak_and_parts_do_not(docs, spark):
    words = ITEM.split()
    moved = " ".join(words[6:] + ["noise"] + words[:6])
    rows = docs((1, f"before, {ITEM.upper()}! after"), (2, f"x {moved} y"), (3, " ".join(words[:6])), (4, " ".join(reversed(words))), (5, ITEM), (5, ITEM), (None, ITEM))
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (13, "no such words are in any of these texts")], "item_id bigint, text string")
    for block in (8 << 20, 40):
        got = D.leaks(rows, bench, block_bytes=block)
        assert got.columns == ["doc_id", "item_id", "n_words", "n_covered", "coverage", "contaminated", "tiles"]
        found = sorted((r.doc_id or 0, r.item_id, r.n_covered, len(r.tiles)) for r in got.collect())
        assert found == [(0, 10, 12, 1), (1, 10, 12, 1), (2, 10, 12, 2), (5, 10, 12, 1), (5, 10, 12, 1)]
        kept = D.clean(rows, bench, block_bytes=block)
        assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    half = D.leaks(rows, bench, coverage=0.5).where("doc_id = 3").first()
    assert [tuple(t) for t in half.tiles] == [(0, 0, 6)]


def test_seed_bound_and_places_in_long_texts():
    items = D.Items([(1, ITEM)], 5, 0.8)
    filler = "lambda mu alpha beta " * 500
    (number, tiles), = items.search(filler + ITEM + " " + filler)
    assert number == 0 and tiles == [(0, 2000, 12)] or sum(t[2] for t in tiles) == 12
    assert items.search(filler) == []


def test_messy_rows(messy, spark):
    bench = spark.createDataFrame([(1, ITEM), (None, "The same text again, the same text again")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(messy, bench).collect()} == {(5, None), (6, None)}
    assert D.leaks(messy.limit(0), bench).count() == 0
    empty = bench.limit(0)
    assert D.leaks(messy, empty).count() == 0 and D.clean(messy, empty).count() == messy.count()


def test_items_shorter_than_a_tile_leak_as_a_whole(docs, spark):
    bench = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "zinc"), (3, "?!"), (4, ITEM)], "item_id bigint, text string")
    rows = docs((1, "who wrote faust"), (2, "He wrote Faust. Who?"), (3, f"zinc: {ITEM}"), (4, ""), (5, "Say: who WROTE Faust, who wrote Faust"))
    got = sorted((r.doc_id, r.item_id, r.n_words, r.coverage) for r in D.leaks(rows, bench).collect())
    assert got == [(1, 1, 3, 1.0), (3, 2, 1, 1.0), (3, 4, 12, 1.0), (5, 1, 3, 1.0)]
    assert sorted(r.doc_id for r in D.clean(rows, bench).collect()) == [2, 4]


def test_blocks_are_bounded_and_held_one_at_a_time(docs, spark, monkeypatch):
    alive, most, sizes, make = weakref.WeakSet(), [], [], D.Items.__init__

    def watched(self, rows, *rest):
        gc.collect()
        most.append(len(alive))
        sizes.append(len(rows))
        make(self, rows, *rest)
        alive.add(self)

    monkeypatch.setattr(D.Items, "__init__", watched)
    other = "one two three four five six seven eight"
    bench = spark.createDataFrame([(7, ITEM)] * 30 + [(8, other), (None, other)], "item_id bigint, text string")
    rows = docs((1, ITEM), (2, f"{other} {ITEM}"), (2, "clean"), (None, None))
    got = sorted((r.doc_id, r.item_id or 0) for r in D.leaks(rows, bench, block_bytes=12).collect())
    assert got == [(1, 7)] * 30 + [(2, 0)] + [(2, 7)] * 30 + [(2, 8)]
    assert len(sizes) > 2 and sum(sizes) == 2 and not any(most)
    kept = D.clean(rows, bench, block_bytes=12)
    assert kept.columns == rows.columns and sorted(r.text or "" for r in kept.collect()) == ["", "clean"] and not any(most)


def test_all_tiles_and_their_coverage_are_those_of_the_plain_definition():
    rng = random.Random(9)
    for _ in range(400):
        letters = rng.choice([2, 4, 12])
        item = [rng.randrange(letters) for _ in range(rng.randint(1, 25))]
        text = [rng.randrange(-1, letters) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            cut = rng.randrange(len(item))
            text += item[cut:] + [-1] + item[:cut]
        covered, plain = plain_tiles(item, text, 3)
        tiles = D.tile(item, text, 3)
        assert sorted((k, p, t) for p, t, k in tiles) == sorted(plain) and sum(k for _, _, k in tiles) == covered


def test_leaks_of_a_table_equal_all_pairs_tiled_plainly(docs, spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(100 + k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(25)]
    items += [(200 + k, "one two three four five six seven eight " + " ".join(rng.choices(vocabulary, k=6))) for k in range(12)]

    def text():
        parts = [rng.choices(vocabulary, k=rng.randint(0, 12))]
        for _ in range(rng.randrange(3)):
            words = D.words(rng.choice(items)[1])
            cut = rng.randrange(len(words))
            parts += [words[cut:], rng.choices(vocabulary, k=rng.randrange(3)), words[:cut]]
        return " ".join(w for p in parts for w in p)

    rows = [(k, text()) for k in range(60)] + [(900, ""), (901, None)]
    want = set()
    for doc, t in rows:
        codes = {}
        number = lambda ws: [codes.setdefault(w, len(codes)) for w in ws]
        own = number(D.words(t or ""))
        for item, it in items:
            words = number(D.words(it))
            covered, tiles = plain_tiles(words, own, min(5, len(words)))
            if covered >= 0.8 * len(words):
                want.add((doc, item, covered, len(tiles)))
    for block in (8 << 20, 300):
        got = {(r.doc_id, r.item_id, r.n_covered, len(r.tiles)) for r in D.leaks(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block).collect()}
        assert got == want and len(want) > 30


def test_items_with_a_common_preamble_are_searched_in_step_with_their_number():
    import time

    preamble = " ".join(f"p{k}" for k in range(40))
    text = f"{preamble} then something else entirely"

    def seconds(n):
        items = D.Items([((k, k), f"{preamble} a{k} b{k} c{k}") for k in range(n)], 5, 0.8)
        start = time.perf_counter()
        assert len(items.search(text)) == n
        return time.perf_counter() - start

    few, many = min(seconds(200) for _ in range(3)), min(seconds(1_600) for _ in range(3))
    assert many < 8 * 2.5 * few + 0.05
