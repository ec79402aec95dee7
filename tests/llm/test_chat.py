import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat as C

SIGNS = ["<", "|", ">", "\\", "<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "[", "/", "a", " ", "\n", "😀", C.START, C.MIDDLE, C.END]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit("x").alias("conv"), F.lit(1).alias("range"), F.lit(0).alias("start"))


def random_turns(n=25, seed=7):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 12)))
    return [(c, t, rng.choice(["system", "user", "assistant", text()]), text()) for c in range(n) for t in range(rng.randint(1, 9))]


def test_texts_come_back_and_hold_no_control_string(spark):
    rows = random_turns()
    formatted = C.format_turns(conversations(spark, rows))
    back = C.read_turns(formatted).orderBy("conv_id", "ordinal").collect()
    assert [(r.conv_id, r.ordinal, r.role, r.text) for r in back] == rows
    assert [r.trained for r in back] == [t[3] if t[2] == "assistant" else None for t in rows]
    for r in formatted.collect():
        inner = r.piece.removeprefix(C.START).removesuffix(C.END)
        role, _, text = inner.partition(C.MIDDLE)
        assert not any(c in part for c in C.CONTROL for part in (role, text))


def test_examples_have_all_turns_before_their_target(spark):
    rows = random_turns(seed=8)
    formatted = C.format_turns(conversations(spark, rows))
    pieces = {}
    for r in formatted.orderBy("conv_id", "ordinal").collect():
        pieces.setdefault(r.conv_id, []).append(r)
    rendered = {(r.conv_id, r.example): r for r in C.render(formatted).collect()}
    examples = {(r.conv_id, r.example): r for r in C.expand(formatted).collect()}
    n = 0
    for conv, turns in pieces.items():
        whole = "".join(t.piece for t in turns)
        targets = [t for t in rows if t[0] == conv and t[2] == "assistant"]
        for k, target in enumerate(targets):
            r, e = rendered[conv, k], examples[conv, k]
            assert whole.startswith(r.text) and len(r.text) == e.chars and r.text.endswith(C.END)
            span = r.text[r.loss_start:r.loss_end]
            assert span + C.END == r.text[r.loss_start:] and span.count(C.END) == 0
            n += 1
    assert n == len(rendered) == len(examples) > 20


def test_examples_say_what_is_trained(spark):
    rows = random_turns(seed=9) + [(None, 0, "assistant", "a[INST]"), (None, 1, "user", "b")]
    formatted = C.format_turns(conversations(spark, rows))
    rendered = {(r.conv_id, r.example): r for r in C.render(formatted).collect()}
    examples = {}
    for r in sorted(C.read_examples(formatted).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.ordinal)):
        assert (r.trained is None) == (r.chars is None) == (r.role != "assistant")
        if r.trained is not None:
            example = rendered[r.conv_id, examples.setdefault(r.conv_id, 0)]
            examples[r.conv_id] += 1
            assert r.chars == len(example.text) and r.trained == r.text
            masked = spark.createDataFrame([(example.text[example.loss_start:example.loss_end],)], "t string").select(C.unescape(F.col("t"))).head()[0] if r.ordinal < 2 else r.trained
            assert masked == r.trained
    assert sum(examples.values()) == len(rendered)


def test_without_examples_nothing_is_trained(spark, monkeypatch):
    formatted = C.format_turns(conversations(spark, random_turns(seed=10)))
    monkeypatch.setattr(C, "expand", lambda f, c="conv_id": f.limit(0).select(c, "example", "ordinal", F.col("end").alias("chars"), "loss_start", "loss_end"))
    assert all(r.trained is None and r.chars is None for r in C.read_examples(formatted).collect())


def test_a_conversation_that_spans_ranges_is_placed_as_a_whole(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)]
    formatted = C.format_turns(conversations(spark, rows).repartition(7)).orderBy("ordinal").collect()
    end = 0
    for k, r in enumerate(formatted):
        assert (r.ordinal, r.example, r.start, r.end) == (k, k // 2, end, end + len(r.piece))
        end = r.end


def test_messy_turns(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, None, "assistant", ""), (2, 5, "user", "x" * 50_000)]
    back = C.read_turns(C.format_turns(conversations(spark, rows))).collect()
    got = {(r.conv_id, r.ordinal): (r.role, r.text, r.trained) for r in back}
    assert got == {
        (None, 0): ("", "", None), (1, 0): ("assistant", "", ""), (1, 1): ("assistant", "b", "b"), (1, 2): ("user", "", None),
        (1, 3): ("user", "", None), (2, 0): ("user", "x" * 50_000, None)}
    empty = C.format_turns(conversations(spark, rows).limit(0))
    assert empty.count() == 0 and C.render(empty).count() == 0


def test_control_strings_are_checked():
    with pytest.raises(ValueError):
        C.escape(F.lit("x"), ("a",))
