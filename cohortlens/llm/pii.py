"""Operator 5, personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four kinds of identifiers that their form gives away are found by pattern (the base spans). They are the seeds. The words
around a span are lexical patterns: the two before it, and the one before with the one behind. Tokens with a digit or
an at sign that are no base span are the candidates, and stand in patterns too. On the graph of patterns and instances,

* a pattern is as sure for a kind as the share of its distinct instances that belong to the kind (plus `doubt` in the
  denominator), if it has `min_seeds` distinct seeds of the kind;
* a candidate belongs to a kind unless every sure pattern in which it stands is wrong: 1 - product of (1 - confidence).

Scores pass to and fro for some rounds. Candidates above the threshold are identifiers of the kind wherever they
occur, and are added to the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import GAP
from cohortlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Repeats that cannot gain by giving back are possessive, so that a run of any length takes no stack,
#: and a search begins at the start of a run only (fixed values).
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_EDGE = r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_CONTEXT = 64  # characters of a text beside a span in which its context words are looked for


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits is right."""
    backwards = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    """Whether a match of the kind's form is a base span."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(f"^(?:{_BYTE}\\.){{3}}{_BYTE}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[0-9]+", "0")), GAP), lambda w: w != "")


def with_matches(rows: DataFrame) -> DataFrame:
    """The rows with `text` and a column `matches`: every match of a form with the text since the match before.

    An element has kind, number, gap (characters since the match before), found, two and around (its patterns).
    """
    forms = {**FORMS, "candidate": CANDIDATE}
    listed = rows.select("*", *[F.regexp_extract_all("text", F.lit(form), F.lit(0)).alias(f"f_{kind}") for kind, form in forms.items()])
    split = listed.select("*", *[F.when(F.size(f"f_{kind}") > 0, F.split("text", form, -1)).alias(f"p_{kind}") for kind, form in forms.items()])

    def one(kind: str) -> Column:
        def match(found: Column, i: Column) -> Column:
            left, right = F.get(f"p_{kind}", i), F.get(f"p_{kind}", i + 1)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("number"), F.length(left).cast("long").alias("gap"), found.alias("found"),
                F.substring(left, -_CONTEXT, _CONTEXT).alias("left"), F.substring(right, 1, _CONTEXT).alias("right"))

        return F.transform(f"f_{kind}", match)

    none = F.array().cast("array<struct<kind:string,number:int,gap:bigint,found:string,left:string,right:string>>")
    matches = F.concat(*[F.when(F.size(f"f_{k}") > 0, one(k)).otherwise(none) for k in forms])
    return split.select(*rows.columns, matches.alias("matches"))


def _patterns(rows: DataFrame) -> DataFrame:
    """One row per match: row, kind, number, gap, found and the two patterns in which it stands."""
    rows = rows.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    before, behind = _words(F.col("left")), _words(F.col("right"))
    two = F.concat_ws(" ", F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), before), -2, 2))
    around = F.concat_ws(" _ ", F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("^")), F.coalesce(F.try_element_at(behind, F.lit(1)), F.lit("$")))
    return rows.select("row", "kind", "number", "gap", "found", two.alias("two"), around.alias("around"))


def spans_of(rows: DataFrame) -> DataFrame:
    """Base spans and candidates of rows (row, matches): row, kind (null for a candidate), start, end, value, two, around."""
    matches = _patterns(rows)
    size = F.length("found").cast("long")
    before = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = matches.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    base = _valid(F.col("kind"), F.col("found"))
    kept = placed.where((F.col("kind") == "candidate") | base)
    # a candidate that touches a base span is not one; its value has no brackets and marks around it
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_base = F.col("kind") != "candidate"
    reach = F.max(F.when(is_base, F.col("end"))).over(upto)
    next_start = F.min(F.when(is_base, F.col("start"))).over(onward)
    free = kept.withColumn("reach", reach).withColumn("next", next_start).where(
        is_base | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))))
    lead = F.length("found") - F.length(F.regexp_replace("found", r"^[\"'(\[{<]+", ""))
    value = F.when(is_base, F.col("found")).otherwise(F.regexp_replace("found", _EDGE, ""))
    start = F.col("start") + F.when(is_base, 0).otherwise(lead)
    return free.select(
        "row", F.when(is_base, F.col("kind")).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"),
        value.alias("value"), "two", "around").where("length(value) > 0")


def discover(found: DataFrame, rounds: int = 3, threshold: float = 0.8, min_seeds: int = 3, doubt: float = 0.5) -> DataFrame:
    """(kind, value, score) of the candidates of `found` (as from `spans_of`) that score at least `threshold`."""
    edges = found.select("kind", "value", F.explode(F.array(F.concat(F.lit("L "), "two"), F.concat(F.lit("B "), "around"))).alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "kind", "value").agg(F.count("*").alias("times")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind IS NOT NULL").select("kind", "value").distinct().select("kind", "value", F.lit(1.0).alias("score"))
    open_edges = edges.where("kind IS NULL").select("pattern", "value")
    # what the seeds give to their patterns stays the same in all rounds
    fixed = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("mass"), F.count("*").alias("seeds"))
    fixed = materialize(fixed.where(F.col("seeds") >= min_seeds).join(sizes, "pattern"), "pii-patterns")
    scores = seeds.limit(0)
    for _ in range(rounds):
        gained = open_edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
        sure = fixed.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("mass") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + doubt)).alias("confidence")).where(F.col("confidence") >= threshold)
        wrong = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9))))
        scores = materialize(open_edges.join(sure, "pattern").groupBy("kind", "value").agg((1 - F.exp(wrong)).alias("score")), "pii-scores")
    return scores.where(F.col("score") >= threshold)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, threshold: float = 0.8, min_seeds: int = 3) -> DataFrame:
    """One row per input row: id, base and spans, arrays of (kind, start, end) in code points, end exclusive.

    Arrays are ordered by kind as in KINDS, then start. `spans` has the base spans and the discovered ones. A null text
    counts as empty and has no span. Null and repeated ids and repeated rows keep their rows; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # row numbers hold only for what is written; texts are read once
    held = materialize(with_matches(rows).drop("text"), "pii-matches")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return held.join(_collected(held, rounds, threshold, min_seeds), "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _collected(rows: DataFrame, rounds: int, threshold: float, min_seeds: int) -> DataFrame:
    """(row, base, spans) of those rows (row, matches) that have a span."""
    found = materialize(spans_of(rows), "pii-spans")
    new = discover(found, rounds, threshold, min_seeds)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    best = new.groupBy("value").agg(F.min_by("kind", F.struct(-F.col("score"), rank)).alias("added"))
    candidates = found.where("kind IS NULL").drop("kind").join(best, "value").select("row", F.col("added").alias("kind"), "start", "end", F.lit(True).alias("new"))
    spans = found.where("kind IS NOT NULL").select("row", "kind", "start", "end", F.lit(False).alias("new")).unionByName(candidates)
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "new", "kind"))).alias("s"))
    plain = lambda s: F.transform(s, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return listed.select("row", plain(F.filter("s", lambda x: ~x["new"])).alias("base"), plain(F.col("s")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rounds: int = 3, threshold: float = 0.8, min_seeds: int = 3) -> DataFrame:
    """The rows of `docs`, all columns, with every span of the text replaced by its kind in brackets.

    Spans that overlap are replaced together, by the kind of the first. Texts without spans, null ones included, stay.
    """
    doc = F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    held = materialize(with_matches(rows), "pii-rows")
    text = F.col("text")
    listed = _collected(held, rounds, threshold, min_seeds).select("row", "spans")
    joined = held.join(listed, "row", "left")
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["end"]
        gap = F.substring(text, (s["end"] + 1).cast("int"), (x["start"] - s["end"]).cast("int"))
        out = F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(gap, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))))
        return F.struct(F.greatest(s["end"], x["end"]).alias("end"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))
    redacted = F.aggregate(by_start, start, step, lambda s: F.concat(F.concat_ws("", s["out"]), F.substring(text, (s["end"] + 1).cast("int"), F.length(text))))
    return joined.select(*[F.when(F.col("spans").isNotNull(), redacted).otherwise(text).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
