"""Operator 8, quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one figure of a text with a cutoff. Its cutoffs are ordered from lenient to strict. For a stratum,
a cutoff is safe if the exact binomial tail of the good labelled texts that it would reject refutes a false-rejection
rate above alpha / rules; the level is divided by the number of strata and rules, and the cutoffs of one rule are tested
in order until one fails, which needs no further correction. The strictest safe cutoff is used, none if no cutoff is
safe. With probability 1 - delta no stratum then loses more than alpha of its good texts to the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import GAP
from cohortlens.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A figure (SQL over the metrics) that must not pass a cutoff; cutoffs from lenient to strict."""

    name: str
    figure: str
    cutoffs: tuple[float, ...]
    above: bool = True

    def breaks(self, cutoff: Column) -> Column:
        """Whether a text breaks the rule; null where the figure or the cutoff is."""
        return F.expr(self.figure) > cutoff if self.above else F.expr(self.figure) < cutoff


RULES = (
    Rule("symbols", "n_symbols / nullif(word_chars, 0)", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06)),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
    Rule("dup_lines", "n_dup_lines / nullif(n_lines, 0)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
    Rule("long_words", "word_chars / nullif(n_words, 0)", (100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 15.0, 12.0)),
    Rule("short_words", "word_chars / nullif(n_words, 0)", (1.2, 1.5, 1.8, 2.0, 2.2, 2.5), above=False),
)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text has no word, a null stratum is the stratum ''. `n_repeat_words` counts the words that windows of three
    cover which occur twice or more in the text. Windows are compared by a 64-bit hash.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select(
        "id", "stratum", F.filter(F.split("text", GAP), lambda w: w != "").alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    hashed = split.select(
        "id", "stratum", "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])).alias("windows"))
    # windows in hash order: equal ones are neighbours; only texts with a repeated window are sorted
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn("ordered", F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def place(k: Column) -> Column:
        own = F.get("ordered", k)
        twin = lambda j: F.coalesce(F.get("ordered", j)["h"] == own["h"], F.lit(False))
        return F.when(twin(k - 1) | twin(k + 1), own["i"])

    found = ordered.withColumn("places", F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("ordered") - 1), place), lambda i: i.isNotNull())))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    covered = F.aggregate("places", start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["words"] + i + WINDOW - F.greatest(s["end"], i)).alias("words")), lambda s: s["words"])
    return found.select(
        "id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(F.when(F.col("ordered").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial with n trials of the given rate, summed exactly in logarithms; 1 from the mean on."""
    odds = rate / (1 - rate)
    first = n * F.log1p(F.lit(-rate))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        total = F.greatest(term, s["sum"]) + F.log1p(F.exp(-F.abs(term - s["sum"])))
        return F.struct(term.alias("term"), total.alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * rate, 1.0).otherwise(F.exp(F.aggregate(steps, start, add, lambda s: s["sum"])))


def thresholds(figures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
               alpha: float = 0.05, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, rule, cutoff, rejected, good, tail): the strictest safe cutoffs of `figures` (as from `metrics`).

    A text is good if any of its labels is 1; labels without id or value are left out, and so are texts with null id. Rows
    that repeat an id count one by one. Strata without good labelled texts have no row.
    """
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).where("label = 1").select("id")
    tests = [(r, step, cut) for r in rules for step, cut in enumerate(r.cutoffs)]
    counts = figures.join(good, "id").groupBy("stratum").agg(
        F.count("*").alias("good"),
        F.array(*[F.struct(
            F.lit(r.name).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"),
            F.count(F.when(r.breaks(F.lit(cut)), 1)).alias("rejected")) for r, step, cut in tests]).alias("tests"))
    counts = materialize(counts, "quality-counts")
    rows = counts.select("stratum", "good", F.inline("tests"))
    tested = rows.withColumn("tail", tail(F.col("rejected"), F.col("good"), alpha / len(rules)))
    level = F.lit(delta / len(rules)) / counts.agg(F.count("*")).scalar()
    in_order = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    safe = tested.withColumn("safe", F.min((F.col("tail") <= level).cast("int")).over(in_order)).where("safe = 1")
    return safe.groupBy("stratum", "rule").agg(
        F.max_by("cutoff", "step").alias("cutoff"), F.max_by("rejected", "step").alias("rejected"),
        F.first("good").alias("good"), F.max_by("tail", "step").alias("tail"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          label_col: str = "quality", min_words: int = 50, max_repeat_percent: int = 50,
          alpha: float = 0.05, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, the metrics, base_failed, broken (names of the rules that it breaks), kept.

    `base_failed`: fewer than `min_words` words, or more than `max_repeat_percent` of them in repeated windows. A text is
    kept if it does not fail there and breaks no rule at the cutoff of its stratum. Null texts have no word and fail.
    Null and repeated ids and repeated rows keep their rows; an empty table gives an empty result, and empty labels no
    cutoff; other columns are not read.
    """
    figures = materialize(metrics(docs, id_col, text_col, stratum_col), "quality-metrics")
    chosen = thresholds(figures, labels, id_col, label_col, alpha, delta, rules)
    cuts = materialize(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules]), "quality-cutoffs")
    judged = figures.join(cuts, "stratum", "left")
    broken = F.filter(F.array(*[F.when(r.breaks(F.col(f"cut_{r.name}")), F.lit(r.name)) for r in rules]), lambda name: name.isNotNull())
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.select(
        F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), broken.alias("broken"), (~failed & (F.size(broken) == 0)).alias("kept"))
