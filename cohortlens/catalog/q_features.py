"""Derived features on the wide panel."""

from __future__ import annotations

from cohortlens import constants as C
from cohortlens.catalog.inputs import names, wide
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import features
from cohortlens.sources import star

S = C.SCORE_INDICATORS
LATEST = (star.LATEST,)
STEPS = list(zip(star.YEARS, star.YEARS[1:]))
COMPOSITE_INPUTS = ("INDE", "IAA", "IDA", "IEG", "IPS")


def _mean(cols):
    present = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    return f"(({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({present}, 0))"


def temporal():
    """(name, expression) of the features over years."""
    out = []
    for s in S:
        cols = names((s,))
        out += [
            *[(f"{s}_diff_{a}_{b}", f"{s}_{b} - {s}_{a}") for a, b in STEPS], (f"{s}_trend", f"{s}_{star.LATEST} - {s}_{star.YEARS[0]}"),
            (f"{s}_mean", _mean(cols)), (f"{s}_std", f"coalesce(list_stddev_samp([{', '.join(cols)}]), 0)"),
        ]
    return out


def _latest(*stems):
    return [f"{s}_{star.LATEST}" for s in stems]


COMPOSITES = [
    ("ACADEMIC_COMPOSITE", _mean(_latest("INDE", "IAA", "IDA"))), ("ENGAGEMENT_COMPOSITE", _mean(_latest("IEG", "IPS"))),
    ("RISK_SCORE", f"10 - {_mean(_latest('INDE', 'IEG', 'IPS'))}"),
]
PROGRESS = [("PROGRESS_INDEX", "PONTO_VIRADA_2001 * ANOS_PM_2001")]
GAP = [("AGE_PHASE_GAP", "IDADE_ALUNO_2001 - FASE_2001 - 6")]
INTERACTIONS = [
    ("INDE_IEG_INTERACTION", "coalesce(INDE_2001, 0) * coalesce(IEG_2001, 0)"), ("IPS_IAA_INTERACTION", "coalesce(IPS_2001, 0) * coalesce(IAA_2001, 0)"),
    ("BOLSISTA_INDE_INTERACTION", "coalesce(BOLSISTA_2001, 0) * coalesce(INDE_2001, 0)"),
]
EVERY = [*temporal(), *COMPOSITES, *PROGRESS, *GAP, *INTERACTIONS]


def _sql(made):
    return ", ".join(r6(expression, name) for name, expression in made)


def _added(df, make):
    spec = star.wide_spec(df)
    made = make(df.columns, spec)
    return rounded(features.build(df, made).select(star.KEY, *[f.name for f in made]))


@query("feat_temporal", f"WITH {wide(S)} SELECT cust_id, {_sql(temporal())} FROM W")
def feat_temporal(spark, d):
    return _added(star.wide(spark, d, S), features.temporal_features)


@query("feat_composite", f"WITH {wide(COMPOSITE_INPUTS, LATEST)} SELECT cust_id, {_sql(COMPOSITES)} FROM W")
def feat_composite(spark, d):
    return _added(star.wide(spark, d, COMPOSITE_INPUTS, LATEST), features.composite_features)


@query("feat_progress", f"WITH {wide(('PONTO_VIRADA', 'ANOS_PM'), LATEST)} SELECT cust_id, {_sql(PROGRESS)} FROM W")
def feat_progress(spark, d):
    return _added(star.wide(spark, d, ("PONTO_VIRADA", "ANOS_PM"), LATEST), features.composite_features)


@query("feat_age_gap", f"WITH {wide(('IDADE_ALUNO', 'FASE'), LATEST)} SELECT cust_id, {_sql(GAP)} FROM W")
def feat_age_gap(spark, d):
    return _added(star.wide(spark, d, ("IDADE_ALUNO", "FASE"), LATEST), features.composite_features)


@query("feat_interaction", f"WITH {wide(('INDE', 'IEG', 'IPS', 'IAA', 'BOLSISTA'), LATEST)} SELECT cust_id, {_sql(INTERACTIONS)} FROM W")
def feat_interaction(spark, d):
    return _added(star.wide(spark, d, ("INDE", "IEG", "IPS", "IAA", "BOLSISTA"), LATEST), features.interaction_features)


@query("feat_all", f"""WITH {wide()}
SELECT cust_id, {', '.join(r6(c, c) for c in names(S))}, {_sql(EVERY)} FROM W""")
def feat_all(spark, d):
    df = star.wide(spark, d)
    spec = star.wide_spec(df)
    built = features.engineer(df, spec)
    return rounded(built.select(star.KEY, *names(S), *[f.name for f in features.default_features(df.columns, spec)]))
