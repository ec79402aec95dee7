"""Derived features as a list of declarations, added to the panel in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens import constants as C
from cohortlens.functions.text import filled, literal, number, or_zero, quoted, row_mean, row_std
from cohortlens.spec import Feature, PanelSpec


def temporal_features(columns: list[str], spec: PanelSpec) -> list[Feature]:
    """Differences between neighbouring available years, last minus first, mean and deviation."""
    out = []
    numeric = set(spec.numeric)
    for stem in spec.indicators:
        years = [y for y in spec.years if f"{stem}_{y}" in columns and f"{stem}_{y}" in numeric]
        if len(years) < 2:
            continue
        names = tuple(f"{stem}_{y}" for y in years)
        for a, b in zip(years, years[1:]):
            out.append(Feature(f"{stem}_diff_{a}_{b}", "difference", (f"{stem}_{b}", f"{stem}_{a}")))
        out += [
            Feature(f"{stem}_trend", "difference", (names[-1], names[0])),
            Feature(f"{stem}_mean", "row_mean", names),
            Feature(f"{stem}_std", "row_std", names),
        ]
    return out


def _present(columns, year, *stems) -> tuple[str, ...]:
    return tuple(f"{s}_{year}" for s in stems if f"{s}_{year}" in columns)


def composite_features(columns: list[str], spec: PanelSpec) -> list[Feature]:
    """Means over the latest year, the inverse risk mean, progress and the age gap."""
    y = spec.latest_year
    out = []
    for name, kind, stems in (
        ("ACADEMIC_COMPOSITE", "row_mean", ("INDE", "IAA", "IDA")),
        ("ENGAGEMENT_COMPOSITE", "row_mean", ("IEG", "IPS")),
        ("RISK_SCORE", "inverse_mean", ("INDE", "IEG", "IPS")),
    ):
        found = _present(columns, y, *stems)
        if found:
            out.append(Feature(name, kind, found, (10.0,) if kind == "inverse_mean" else ()))
    progress = _present(columns, y, C.TURNING_POINT, C.TENURE)
    if len(progress) == 2:
        out.append(Feature("PROGRESS_INDEX", "product", progress))
    gap = _present(columns, y, C.AGE, C.PHASE)
    if len(gap) == 2:
        out.append(Feature("AGE_PHASE_GAP", "linear", gap, (1.0, -1.0, -6.0)))
    return out


def interaction_features(columns: list[str], spec: PanelSpec) -> list[Feature]:
    """Products of pairs in the latest year; a null counts as 0."""
    pairs = (
        ("INDE_IEG_INTERACTION", "INDE", "IEG"),
        ("IPS_IAA_INTERACTION", "IPS", "IAA"),
        ("BOLSISTA_INDE_INTERACTION", C.SCHOLARSHIP, "INDE"),
    )
    found = [(name, _present(columns, spec.latest_year, a, b)) for name, a, b in pairs]
    return [Feature(name, "product_or_zero", inputs) for name, inputs in found if len(inputs) == 2]


def default_features(columns: list[str], spec: PanelSpec) -> list[Feature]:
    return temporal_features(columns, spec) + composite_features(columns, spec) + interaction_features(columns, spec)


# A formula gets the inputs as numeric SQL and the parameters.
FORMULAS = {
    "difference": lambda xs, _: f"{xs[0]} - {xs[1]}",
    "row_mean": lambda xs, _: row_mean(xs),
    "row_std": lambda xs, _: row_std(xs),
    "inverse_mean": lambda xs, p: f"{literal(p[0])} - {row_mean(xs)}",
    "product": lambda xs, _: " * ".join(xs),
    "product_or_zero": lambda xs, _: " * ".join(map(or_zero, xs)),
    # any SQL expression; {0}, {1}, ... stand for the inputs
    "expression": lambda xs, p: f"({p[0].format(*xs)})",
    # weights of the inputs, then a constant
    "linear": lambda xs, p: " + ".join(f"{x} * {literal(w)}" for x, w in zip(xs, p)) + f" + {literal(p[len(xs)])}",
}


def build(df: DataFrame, features: list[Feature]) -> DataFrame:
    """All columns of the frame and the features.

    Means and counts that deviations are made of come first, as columns: written out in every term they make code that Spark can
    only interpret.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = {f.kind for f in features} - set(FORMULAS)
    if unknown:
        raise ValueError(f"unknown feature kinds {sorted(unknown)}; one of {sorted(FORMULAS)}")
    inputs = {f: [number(c, types[c]) for c in f.inputs] for f in features}
    made = {f: (f"_mean_{i}", f"_filled_{i}") for i, f in enumerate(features) if f.kind == "row_std"}
    helped = df.selectExpr("*", *[f"{row_mean(inputs[f])} AS {m}" for f, (m, _) in made.items()], *[f"{filled(inputs[f])} AS {n}" for f, (_, n) in made.items()]) if made else df
    formula = {f: row_std(inputs[f], *made[f]) if f in made else FORMULAS[f.kind](inputs[f], f.params) for f in features}
    return helped.selectExpr("*", *[f"{formula[f]} AS {quoted(f.name)}" for f in features]).drop(*[c for pair in made.values() for c in pair])


def engineer(df: DataFrame, spec: PanelSpec, own: list[Feature] = ()) -> DataFrame:
    """The default features and the user's own beside the originals."""
    return build(df, [*default_features(df.columns, spec), *own])
