"""Exact order statistics of many columns by radix selection: a fixed kind of pass, each a count by column and digit.

A pass gives every value a digit that never falls as the value rises, counts values by column and digit (that is all a task
sends), and keeps for each wanted rank the one digit that holds it, with its smallest and largest value. The first digit is a
64th of a power of two, so it suits values of any size; later ones cut the range that is left into BINS equal parts, and only
values in that range are looked at. A range shrinks until its ends are equal, after about three passes for most data and
six at the worst. No row is shuffled and nothing is estimated.

The driver holds one range per column and wanted rank, so its part is bounded by the schema.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.shape import present
from cohortlens.functions.text import quoted
from cohortlens.session import materialize

BINS = 1024
_FAR = 200_000  # above the digit of any number of doubles


@dataclass
class Moments:
    n: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None


def doubles(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """The columns as doubles, NaN as null, written once so that passes read nothing else."""
    kinds = dict(df.dtypes)
    cells = [f"cast({present(c, kinds[c])} AS double) AS {quoted(c)}" for c in columns]
    return materialize(df.selectExpr(*map(quoted, keep), *cells), "doubles")


def _digit(c: str) -> str:
    size = f"{_FAR} + floor(log2(abs({c})) * 64)"
    return (f"CASE WHEN {c} = 0 THEN 0L WHEN {c} = double('Infinity') THEN {2 * _FAR}L WHEN {c} = double('-Infinity') THEN {-2 * _FAR}L "
            f"WHEN {c} > 0 THEN {size} ELSE -({size}) END")


def _entries(df: DataFrame, cells: list[str]) -> DataFrame:
    """(i, v) of every cell that is not null. What is made of a value comes after, once, and not for each column."""
    return df.selectExpr(f"array({', '.join(cells)}) AS cells").selectExpr("posexplode(cells) AS (i, v)").where("v IS NOT NULL")


def _holding(counts: DataFrame, ranks: list[list[int]]) -> DataFrame:
    """The digits that hold one of the ranks of their group, with the number of values below."""
    upto = Window.partitionBy("i").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("below", F.sum("n").over(upto) - F.col("n"))
    wanted = F.get(F.expr(f"array({', '.join('array(' + ', '.join(f'{r}L' for r in rs) + ')' for rs in ranks)})"), F.col("i"))
    return placed.where(F.exists(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))))


def ranks_of(n: int, probabilities: list[float]) -> list[int]:
    """Ranks (from 0) between which the quantiles of n values lie."""
    return sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)}) if n else []


def order_statistics(df: DataFrame, columns: list[str], probabilities: list[float], stored: bool = False) -> tuple[list[list[float | None]], list[Moments]]:
    """Per column the quantiles, linearly interpolated (null without values), and count, mean, deviation and range.

    `stored` says that the columns are doubles without NaN that are cheap to read, as from `doubles`; else they are written first.
    """
    if not stored:
        df = doubles(df, columns)
    first = _entries(df, [quoted(c) for c in columns]).selectExpr("i", f"{_digit('v')} AS digit", "v")
    counts = materialize(first.groupBy("i", "digit").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")), "digits")
    # one row per column: groups of a column are few, since a digit is a 64th of a power of two
    whole = counts.groupBy("i").agg(F.sum("n").alias("all"), F.min("low").alias("least"), F.max("high").alias("most"))
    n, off = F.col("n"), F.col("mean") - F.col("least")
    merged = counts.join(F.broadcast(whole), "i").groupBy("i", "all", "least", "most").agg(
        F.sum(n * off).alias("s1"), F.sum(n * off * off).alias("s2"), F.sum(n * F.col("var")).alias("v"))
    moments = [Moments(0, None, None, None, None) for _ in columns]
    for r in merged.collect():
        squares = r["v"] + r["s2"] - r["s1"] * r["s1"] / r["all"]
        std = math.sqrt(max(squares, 0.0) / (r["all"] - 1)) if r["all"] > 1 else None
        moments[r["i"]] = Moments(r["all"], r["least"] + r["s1"] / r["all"], std, r["least"], r["most"])
    wanted = [ranks_of(m.n, probabilities) for m in moments]
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, float, float], list[tuple[int, int]]] = {}  # range -> (rank, values below the range)

    def settle(held: DataFrame, origin: list[tuple[int, list[tuple[int, int]]]]) -> None:
        for r in held.collect():
            column, ranks = origin[r["i"]]
            for rank, before in ranks:
                if r["below"] <= rank - before < r["below"] + r["n"]:
                    if r["low"] == r["high"]:
                        found[column, rank] = r["low"]
                    else:
                        open_.setdefault((column, r["low"], r["high"]), []).append((rank, before + r["below"]))

    settle(_holding(counts, wanted), [(i, [(r, 0) for r in rs]) for i, rs in enumerate(wanted)])
    while open_:
        ranges = list(open_.items())
        cells = [f"CASE WHEN {quoted(columns[i])} BETWEEN {low!r}D AND {high!r}D THEN {quoted(columns[i])} END" for (i, low, high), _ in ranges]
        low, high = (f"get(array({', '.join(f'{r[k]!r}D' for r, _ in ranges)}), i)" for k in (1, 2))
        digit = f"least(floor((v - {low}) / ({high} - {low}) * {BINS}D), {BINS - 1}L) AS digit"
        counts = _entries(df, cells).selectExpr("i", digit, "v").groupBy("i", "digit").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        origin = [(i, ranks) for (i, _, _), ranks in ranges]
        open_ = {}
        settle(_holding(counts, [[rank - before for rank, before in ranks] for _, ranks in origin]), origin)

    def quantile(i: int, p: float) -> float | None:
        if not moments[i].n:
            return None
        position = p * (moments[i].n - 1)
        low, high = found[i, math.floor(position)], found[i, math.ceil(position)]
        return low + (high - low) * (position - math.floor(position))

    return [[quantile(i, p) for p in probabilities] for i in range(len(columns))], moments
