"""Panels, windows, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlens import constants as C
from cohortlens.catalog.inputs import PANEL, names, wide
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.functions.text import literal, number
from cohortlens.operators import columns, contract, impute, panel, profile, target
from cohortlens.sources import star

S = C.SCORE_INDICATORS
THREE = ("INDE", "IAA", "IEG")


def _rounded_sql(cols):
    return ", ".join(r6(c, c) for c in cols)


@query("panel_long", f"""WITH {PANEL}
SELECT cust_id, year, {_rounded_sql(S)}, DEFASAGEM, PONTO_VIRADA, FASE, IDADE_ALUNO, PEDRA, TURMA, BOLSISTA, ANOS_PM FROM P""")
def panel_long(spark, d):
    return rounded(star.panel(spark, d))


@query("panel_pivot", f"""WITH {wide(('INDE', 'IAA', 'PEDRA', 'FASE'))}
SELECT cust_id, {_rounded_sql(names(('INDE', 'IAA')))}, {', '.join(names(('PEDRA', 'FASE')))} FROM W""")
def panel_pivot(spark, d):
    return rounded(star.wide(spark, d, ("INDE", "IAA", "PEDRA", "FASE")))


@query("panel_unpivot", f"""WITH {wide(THREE)},
U AS (SELECT * FROM W UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(names(THREE))})))
SELECT cust_id, regexp_extract(variable, '^(.*)_[0-9]+$', 1) AS indicator,
       CAST(right(variable, 4) AS INTEGER) AS year, {r6('value', 'value')} FROM U""")
def panel_unpivot(spark, d):
    df = star.wide(spark, d, THREE)
    return rounded(panel.melt_years(df, star.wide_spec(df), list(THREE)))


@query("panel_wide_to_long", f"""WITH {PANEL}
SELECT cust_id, year, {_rounded_sql(THREE)} FROM P""")
def panel_wide_to_long(spark, d):
    df = star.wide(spark, d, THREE)
    return rounded(panel.to_long(df, star.wide_spec(df), list(THREE)))


@query("panel_latest_year", f"WITH {PANEL} SELECT max(year) AS latest_year FROM P")
def panel_latest_year(spark, d):
    return panel.latest_year(star.panel(spark, d, ()))


@query("panel_year_slice", f"""WITH {wide(('INDE', 'IAA', 'TURMA'))}
SELECT cust_id, {_rounded_sql(('INDE_2001', 'IAA_2001'))}, TURMA_2001 FROM W""")
def panel_year_slice(spark, d):
    return rounded(panel.year_slice(star.wide(spark, d, ("INDE", "IAA", "TURMA")), 2001, star.KEY))


@query("panel_yearly_means", f"WITH {PANEL} SELECT year, {', '.join(r6(f'avg({s})', s) for s in S)} FROM P GROUP BY year")
def panel_yearly_means(spark, d):
    return rounded(profile.yearly_means(star.panel(spark, d, S), "year", S))


@query("panel_yearly_means_wide", f"""WITH {PANEL}
SELECT year, {', '.join(r6(f'avg({s})', s) for s in THREE)} FROM P GROUP BY year""")
def panel_yearly_means_wide(spark, d):
    return rounded(profile.yearly_means_wide(star.wide(spark, d, THREE), star.YEARS, THREE))


@query("win_yoy_diff", f"""WITH {PANEL}
SELECT cust_id, year, {', '.join(r6(f'{s} - lag({s}) OVER (PARTITION BY cust_id ORDER BY year)', f'{s}_diff') for s in S)} FROM P""")
def win_yoy_diff(spark, d):
    df = panel.yearly_changes(star.panel(spark, d, S), star.KEY, "year", S)
    return rounded(df.select(star.KEY, "year", *[f"{s}_diff" for s in S]))


@query("win_trend", f"""WITH {PANEL}
SELECT cust_id, {', '.join(r6(f'arg_max({s}, year) - arg_min({s}, year)', f'{s}_trend') for s in S)} FROM P GROUP BY cust_id""")
def win_trend(spark, d):
    return rounded(panel.entity_trend(star.panel(spark, d, S), star.KEY, "year", S))


@query("win_mean_std", f"""WITH {PANEL}
SELECT cust_id, {', '.join(r6(f'avg({s})', f'{s}_mean') for s in S)},
       {', '.join(r6(f'coalesce(stddev_samp({s}), 0)', f'{s}_std') for s in S)} FROM P GROUP BY cust_id""")
def win_mean_std(spark, d):
    return rounded(panel.entity_moments(star.panel(spark, d, S), star.KEY, S))


@query("win_position", f"""WITH {PANEL}
SELECT cust_id, year, {r6('INDE', 'INDE')}, CAST(row_number() OVER w AS INTEGER) AS position, {r6('lag(INDE) OVER w', 'previous')},
       {r6('first_value(INDE) OVER f', 'first_value')}, {r6('last_value(INDE) OVER f', 'last_value')}
FROM P WINDOW w AS (PARTITION BY cust_id ORDER BY year),
              f AS (PARTITION BY cust_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_position(spark, d):
    return rounded(panel.entity_window(star.panel(spark, d, ("INDE",)), star.KEY, "year", "INDE"))


@query("proj_drop_ids", """SELECT c_custkey AS cust_key, c_nationkey AS nation, """ + r6("c_acctbal", "balance") + " FROM customer")
def proj_drop_ids(spark, d):
    people = star.table(spark, d, "customer").select(
        F.col("c_custkey").alias("cust_key"), F.col("c_custkey").alias("ID"), F.col("c_name").alias("NOME"),
        F.col("c_name").alias("Nome_Completo"), F.col("c_mktsegment").alias("turma_matricula"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
    )
    return rounded(columns.drop_identifiers(people, keep=("cust_key",)))


@query("proj_drop_leakage", f"""WITH {wide(('INDE', 'FASE'), (2001,))}
SELECT cust_id, {r6('INDE_2001', 'INDE_2001')}, FASE_2001, {r6('INDE_2001', 'MEDIANA_2001')} FROM W""")
def proj_drop_leakage(spark, d):
    df = star.wide(spark, d, ("INDE", "FASE", "DEFASAGEM"), (2001,)).select(
        "*", F.col("INDE_2001").alias("IAN_2001"), F.col("FASE_2001").alias("NIVEL_IDEAL_2001"),
        F.col("INDE_2001").alias("MEDIANA_2001"),
    )
    return rounded(columns.drop_leakage(df))


@query("target_notnull", f"""WITH {wide(('DEFASAGEM', 'FASE'), (2001,))}
SELECT cust_id, DEFASAGEM_2001, FASE_2001 FROM W WHERE DEFASAGEM_2001 IS NOT NULL""")
def target_notnull(spark, d):
    df = star.wide(spark, d, ("DEFASAGEM", "FASE"), (2001,))
    return target.binarize(df, target.resolve(df.columns, 2001), "negative_is_risk").drop("label")


@query("target_binarize", f"""WITH {wide(('DEFASAGEM',))}
SELECT cust_id, CAST(CASE WHEN DEFASAGEM_2001 < 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM W WHERE DEFASAGEM_2001 IS NOT NULL""")
def target_binarize(spark, d):
    df = star.wide(spark, d, ("DEFASAGEM",))
    return target.binarize(df, target.resolve(df.columns, None), "negative_is_risk").select(star.KEY, "label")


@query("na_drop", f"""WITH {wide(('INDE', 'FASE'))}
SELECT cust_id, {_rounded_sql(names(('INDE',)))}, {', '.join(names(('FASE',)))} FROM W
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names(('INDE', 'FASE')))}""")
def na_drop(spark, d):
    return rounded(impute.drop_incomplete(star.wide(spark, d, ("INDE", "FASE"))))


@query("na_drop_subset", f"""WITH {wide(('INDE', 'DEFASAGEM'))}
SELECT cust_id, {_rounded_sql(names(('INDE',)))}, {', '.join(names(('DEFASAGEM',)))} FROM W
WHERE INDE_2001 IS NOT NULL AND DEFASAGEM_2001 IS NOT NULL""")
def na_drop_subset(spark, d):
    df = star.wide(spark, d, ("INDE", "DEFASAGEM"))
    return rounded(impute.drop_incomplete(df, ["INDE_2001", "DEFASAGEM_2001"]))


@query("score_align", f"""WITH {wide(('INDE', 'FASE', 'IAA'), (2000, 2001))}
SELECT cust_id, {r6('coalesce(FASE_2001, 0)', 'FASE_2001')}, {r6('coalesce(INDE_2001, 0)', 'INDE_2001')},
       {r6('0', 'IPP_2001')}, {r6('coalesce(IAA_2000, 0)', 'IAA_2000')} FROM W""")
def score_align(spark, d):
    df = star.wide(spark, d, ("INDE", "FASE", "IAA"), (2000, 2001))
    return rounded(columns.align(df, ["FASE_2001", "INDE_2001", "IPP_2001", "IAA_2000"], keep=(star.KEY,)))


CHECKED = tuple(c for c in star.YEARLY if c in C.CONTRACT_BOUNDS)
_SHIFT = "IDADE_ALUNO_2001 + CASE WHEN cust_id % 17 = 0 THEN 20 ELSE 0 END"


def _records(spark, d):
    """Records of all years; some ages of the latest one are moved out of bounds."""
    return star.wide(spark, d, CHECKED).withColumn("IDADE_ALUNO_2001", F.expr(_SHIFT).cast("int"))


def _violation(name):
    low, high = C.CONTRACT_BOUNDS[name.rsplit("_", 1)[0]]
    return f"{name} NOT BETWEEN {low} AND {high}"


_BOUND = sorted(names(CHECKED))
_RECORDS = f"{wide(CHECKED)},\nR AS (SELECT * REPLACE (CAST({_SHIFT} AS INTEGER) AS IDADE_ALUNO_2001) FROM W)"
BROKEN = " OR ".join(f"coalesce({_violation(c)}, false)" for c in _BOUND)
VIOLATIONS = f"concat_ws(',', {', '.join(f'CASE WHEN {_violation(c)} THEN {literal(c)} END' for c in _BOUND)})"


def rules(df):
    return contract.panel_rules(df.columns, star.YEARS)


@query("dq_contract_violations", f"WITH {_RECORDS},\nT AS (SELECT {', '.join(f'count(*) FILTER (WHERE {_violation(c)}) AS {c}' for c in _BOUND)} FROM R),\n"
       f"V AS (SELECT unnest([{', '.join(literal(c) for c in _BOUND)}]) AS rule, unnest([{', '.join(f'{float(C.CONTRACT_BOUNDS[c[:-5]][0])}::DOUBLE' for c in _BOUND)}]) AS low, "
       f"unnest([{', '.join(f'{float(C.CONTRACT_BOUNDS[c[:-5]][1])}::DOUBLE' for c in _BOUND)}]) AS high, unnest([{', '.join(_BOUND)}]) AS n_violations FROM T)\nSELECT * FROM V")
def dq_contract_violations(spark, d):
    df = _records(spark, d)
    return contract.violation_counts(df, rules(df))


@query("dq_valid_rows", f"WITH {_RECORDS}\nSELECT cust_id, {', '.join(names(('IDADE_ALUNO', 'FASE')))} FROM R WHERE NOT ({BROKEN})")
def dq_valid_rows(spark, d):
    df = _records(spark, d)
    valid, _ = contract.split(df, rules(df))
    return valid.select(star.KEY, *names(("IDADE_ALUNO", "FASE")))


@query("dq_quarantine", f"WITH {_RECORDS}\nSELECT cust_id, {VIOLATIONS} AS violations FROM R WHERE {BROKEN}")
def dq_quarantine(spark, d):
    df = _records(spark, d)
    _, bad = contract.split(df, rules(df))
    return bad.select(star.KEY, F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query("preview_head", f"""WITH {wide(('INDE', 'TURMA'))}
SELECT cust_id, {_rounded_sql(names(('INDE',)))}, {', '.join(names(('TURMA',)))} FROM W ORDER BY cust_id LIMIT 20""")
def preview_head(spark, d):
    return rounded(columns.head(star.wide(spark, d, ("INDE", "TURMA")), star.KEY, 20))


@query("num_coerce", """SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k,
       CAST(NULL AS DOUBLE) AS from_text FROM events""")
def num_coerce(spark, d):
    df = star.table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), "event_type"
    )
    kind = StringType()
    return df.selectExpr("event_id", f"{number('k', kind)} AS k", f"{number('event_type', kind)} AS from_text")


@query("json_props_extract", """SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_props_extract(spark, d):
    return star.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
