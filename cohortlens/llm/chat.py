"""Operator 9, chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are its context, only its text is trained on. The
examples of a conversation share their prefixes, so the formatted turns are stored once, each with its place in the
formatted conversation, and an example is the reference to its prefix (from 0 to its end) and its loss span. The size
of the result is that of the input, also for a conversation of millions of turns. `render` writes the examples out.

A conversation is not kept together: turns are sorted by range, and running sums are taken inside a range and over the
totals of the ranges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import materialize

START, MIDDLE, END = "<|start|>", "<|text|>", "<|end|>"
#: Strings that a text must not bring into the formatted conversation (fixed values).
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Double the backslashes, then put one behind the first character of every control string."""
    if any(len(c) < 2 or "\\" in c for c in control):
        raise ValueError("control strings have two characters at least and no backslash")
    found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per turn: conversation, ordinal, example, piece, start, end, loss_start, loss_end.

    `piece` is the formatted turn, `start` and `end` its place in the formatted conversation in code points, `example`
    the number of the example that it first belongs to, from 0. A turn of the role `target` ends that example, and
    its loss span is set; for other turns it is null. Null role and null text count as empty. Turns of a conversation are ordered by
    turn (null first), then role, then text, so repeated and tied rows all stay, in a fixed order. A null conversation
    id is a conversation like any other. An empty table gives an empty result; other columns are not read.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    order = ["conv", "turn", "role", "text"]
    formatted = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).select(
        *order, F.spark_partition_id().alias("range"), F.concat(head, body, F.lit(END)).alias("piece"),
        F.length(head).cast("long").alias("head_chars"), F.length(body).cast("long").alias("body_chars"),
        (F.col("role") == target).cast("long").alias("is_target"))
    formatted = materialize(formatted, "chat-turns")
    size = F.length("piece").cast("long")
    inside = Window.partitionBy("range", "conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = formatted.groupBy("range", "conv").agg(F.count("*").alias("n"), F.sum(size).alias("c"), F.sum("is_target").alias("t"))
    totals = totals.select("range", "conv", *[F.coalesce(F.sum(k).over(before), none).alias(f"{k}0") for k in "nct"])
    placed = formatted.select(
        "range", "conv", "piece", "head_chars", "body_chars", "is_target", size.alias("size"),
        F.count("*").over(inside).alias("n1"), F.coalesce(F.sum(size).over(inside), none).alias("c1"),
        F.coalesce(F.sum("is_target").over(inside), none).alias("t1"))
    joined = placed.alias("a").join(totals.alias("b"), (F.col("a.range") == F.col("b.range")) & F.col("a.conv").eqNullSafe(F.col("b.conv")))
    start = F.col("c0") + F.col("c1")
    spoken = F.when(F.col("is_target") == 1, start + F.col("head_chars"))
    return joined.select(
        F.col("a.conv").alias(conv_col), (F.col("n0") + F.col("n1")).alias("ordinal"), (F.col("t0") + F.col("t1")).alias("example"), "piece",
        start.alias("start"), (start + F.col("size")).alias("end"), spoken.alias("loss_start"), (spoken + F.col("body_chars")).alias("loss_end"))


def expand(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per example, that is per target turn: conversation, example, ordinal, chars, loss_start, loss_end.

    The text of an example is the first `chars` characters of the formatted conversation; `ordinal` is the turn that ends it.
    """
    return formatted.where("loss_start IS NOT NULL").select(conv_col, "example", "ordinal", F.col("end").alias("chars"), "loss_start", "loss_end")


def read_examples(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The turns of `read_turns` with what the examples train on: conversation, ordinal, role, text, trained, chars.

    `trained` is the text under the loss mask of the example that the turn ends, cut out by its loss span, `chars` the length of that
    example; both are null for a turn that ends no example.
    """
    turns = read_turns(formatted, conv_col).drop("trained").alias("t")
    pieces = formatted.select(F.col(conv_col).alias("conv"), F.col("ordinal").alias("at"), "piece", "start").alias("p")
    same = F.col(f"e.{conv_col}").eqNullSafe(F.col("p.conv")) & (F.col("e.ordinal") == F.col("p.at"))
    cut = F.col("piece").substr((F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    masked = expand(formatted, conv_col).alias("e").join(pieces, same).select(
        F.col(f"e.{conv_col}").alias("conv"), F.col("e.ordinal").alias("at"), unescape(cut).alias("trained"), "chars").alias("m")
    mine = F.col(f"t.{conv_col}").eqNullSafe(F.col("m.conv")) & (F.col("t.ordinal") == F.col("m.at"))
    return turns.join(masked, mine, "left").select(F.col(f"t.{conv_col}").alias(conv_col), "t.ordinal", "t.role", "t.text", "m.trained", "m.chars")


def render(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per example with its whole text: conversation, example, text, loss_start, loss_end.

    What it writes grows with the square of a conversation's turns, as prefix-target expansion does; use it for
    conversations that fit into a row.
    """
    pieces = formatted.select(F.col(conv_col).alias("conv"), "ordinal", "piece", F.col("example").alias("first"))
    examples = expand(formatted, conv_col).alias("e")
    joined = examples.join(pieces.alias("p"), F.col(f"e.{conv_col}").eqNullSafe(F.col("p.conv")) & (F.col("p.first") <= F.col("e.example")))
    grouped = joined.groupBy(F.col(f"e.{conv_col}").alias(conv_col), "example", "loss_start", "loss_end").agg(
        F.array_sort(F.collect_list(F.struct("p.ordinal", "p.piece"))).alias("turns"))
    return grouped.select(conv_col, "example", F.concat_ws("", F.col("turns.piece")).alias("text"), "loss_start", "loss_end")


def read_turns(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read role and text back from the formatted turns: conversation, ordinal, role, text, trained.

    `trained` is the text under the loss mask, cut from the piece by the loss span; null where there is none.
    """
    form = f"(?s)^{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*){re.escape(END)}$"
    cut = F.col("piece").substr((F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return formatted.select(
        conv_col, "ordinal", unescape(F.regexp_extract("piece", form, 1)).alias("role"),
        unescape(F.regexp_extract("piece", form, 2)).alias("text"), unescape(cut).alias("trained"), "start", "end")
