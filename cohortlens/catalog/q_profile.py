"""Profiling and imputation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.catalog.inputs import PANEL, melted, names, wide
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.operators import impute, profile, target
from cohortlens.sources import star
from cohortlens.sources.star import YEARLY

S = C.SCORE_INDICATORS
MIXED = ("INDE", "FASE", "TURMA")
ALL = names(YEARLY)

_NULLS = "N AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_nulls, count(*) AS n_rows FROM W" for c in ["cust_id", *ALL]
) + ")"
_WIDE_NULLS = f"{wide()},\n{_NULLS}"


@query("profile_null_total", f"WITH {_WIDE_NULLS} SELECT CAST(sum(n_nulls) AS BIGINT) AS total_nulls FROM N")
def profile_null_total(spark, d):
    return profile.null_total(star.wide(spark, d))


@query("profile_null_top", f"""WITH {_WIDE_NULLS}
SELECT "column", n_nulls FROM N WHERE n_nulls > 0 ORDER BY n_nulls DESC, "column" LIMIT 20""")
def profile_null_top(spark, d):
    return profile.null_top(star.wide(spark, d))


@query("profile_null_pct", f"""WITH {_WIDE_NULLS}
SELECT "column", {r6('n_nulls * 100 / n_rows', 'null_pct')} FROM N WHERE n_nulls > 0
ORDER BY CAST(n_nulls AS DOUBLE) * 100 / n_rows DESC, "column" LIMIT 30""")
def profile_null_pct(spark, d):
    return rounded(profile.null_percent(star.wide(spark, d)))


@query("profile_overview", f"""WITH {_WIDE_NULLS}
SELECT max(n_rows) AS n_rows, CAST({len(ALL) + 1} AS BIGINT) AS n_columns, max(n_rows) * {len(ALL) + 1} AS n_cells,
       CAST(sum(n_nulls) AS BIGINT) AS null_cells, {r6(f'sum(n_nulls) * 100 / (max(n_rows) * {len(ALL) + 1})', 'null_pct')} FROM N""")
def profile_overview(spark, d):
    return rounded(profile.overview(star.wide(spark, d)))


NUMERIC = tuple(c for c in YEARLY if c not in (C.ORDINAL, C.GROUP))
DESCRIBED = names(NUMERIC)


@query("profile_describe", f"""WITH {wide(NUMERIC)}, L AS ({melted(DESCRIBED)})
SELECT "column", count(value) AS count, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')},
       {r6('quantile_cont(value, 0.25)', 'q0_25')}, {r6('quantile_cont(value, 0.5)', 'q0_5')},
       {r6('quantile_cont(value, 0.75)', 'q0_75')}, {r6('max(value)', 'max')} FROM L GROUP BY "column" """)
def profile_describe(spark, d):
    return rounded(profile.describe(star.wide(spark, d, NUMERIC), DESCRIBED))


@query("value_counts_category", f"""WITH {PANEL}
SELECT PEDRA AS value, count(*) AS n FROM P GROUP BY PEDRA""")
def value_counts_category(spark, d):
    return profile.category_counts(star.panel(spark, d, ("PEDRA",)), "PEDRA")


@query("value_counts_many", f"""WITH {PANEL}
SELECT 'PEDRA' AS "column", PEDRA AS value, count(*) AS n FROM P GROUP BY PEDRA
UNION ALL SELECT 'TURMA', TURMA, count(*) FROM P GROUP BY TURMA
UNION ALL SELECT 'FASE', CAST(FASE AS VARCHAR), count(*) FROM P GROUP BY FASE""")
def value_counts_many(spark, d):
    return profile.category_counts_many(star.panel(spark, d), ["PEDRA", "TURMA", "FASE"])


@query("target_distribution", f"""WITH {PANEL}, Y AS (SELECT CAST(CASE WHEN DEFASAGEM < 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM P)
SELECT label, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()', 'share')} FROM Y GROUP BY label""")
def target_distribution(spark, d):
    return rounded(target.distribution(target.binarize(star.panel(spark, d, ("DEFASAGEM",)), "DEFASAGEM"), "label"))


_PAIRS = list(combinations(S, 2))
_CORR = "K AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM P" for a, b in _PAIRS) + ")"


@query("corr_matrix", f"""WITH {PANEL}, {_CORR}
SELECT a, b, {r6('corr', 'corr')} FROM K UNION ALL SELECT b, a, {r6('corr')} FROM K
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{s}', '{s}', 1.0::DOUBLE)" for s in S)}) v""")
def corr_matrix(spark, d):
    return rounded(profile.correlation_matrix(star.panel(spark, d, S), list(S)))


@query("corr_top_pairs", f"WITH {PANEL}, {_CORR} SELECT a, b, {r6('corr', 'corr')} FROM K ORDER BY K.corr DESC, a, b LIMIT 5")
def corr_top_pairs(spark, d):
    return rounded(profile.top_pairs(star.panel(spark, d, S), list(S), 5))


_PAIRWISE = list(combinations(names(S), 2))


@query("corr_pairwise_nulls", f"""WITH {wide(S)}, K AS (SELECT {', '.join(f'corr({a}, {b}) AS p{k}' for k, (a, b) in enumerate(_PAIRWISE))} FROM W),
U AS (SELECT unnest([{', '.join(f"'{a}'" for a, _ in _PAIRWISE)}]) AS a, unnest([{', '.join(f"'{b}'" for _, b in _PAIRWISE)}]) AS b, unnest([{', '.join(f'p{k}' for k in range(len(_PAIRWISE)))}]) AS corr FROM K)
SELECT a, b, {r6('CASE WHEN isfinite(corr) THEN corr END', 'corr')} FROM U""")
def corr_pairwise_nulls(spark, d):
    """All indicators and years, with gaps: too many pairs for one aggregate."""
    return rounded(profile.correlations(star.wide(spark, d, S), names(S)))


@query("select_by_correlation", f"""WITH {PANEL}, Y AS (SELECT *, CASE WHEN DEFASAGEM < 0 THEN 1 ELSE 0 END AS label FROM P),
K AS ({' UNION ALL '.join(f"SELECT '{s}' AS column, abs(corr({s}, label)) AS c FROM Y" for s in S)})
SELECT "column", {r6('c', 'abs_corr')} FROM K ORDER BY c DESC, "column" LIMIT 3""")
def select_by_correlation(spark, d):
    df = target.binarize(star.panel(spark, d, (*S, "DEFASAGEM")), "DEFASAGEM")
    ranked = profile.correlation_with(df, list(S), "label")
    return rounded(ranked.orderBy(F.desc("abs_corr"), "column").limit(3))


@query("nunique", f"""WITH {PANEL}
SELECT 'PEDRA' AS "column", count(DISTINCT PEDRA) AS n_distinct FROM P UNION ALL SELECT 'FASE', count(DISTINCT FASE) FROM P
UNION ALL SELECT 'DEFASAGEM', count(DISTINCT DEFASAGEM) FROM P UNION ALL SELECT 'cust_id', count(DISTINCT cust_id) FROM P""")
def nunique(spark, d):
    return profile.distinct_counts(star.panel(spark, d, ("PEDRA", "FASE", "DEFASAGEM")), ["PEDRA", "FASE", "DEFASAGEM", "cust_id"])


def _hist_sql(source, keys, bins):
    lead = "".join(f"{k}, " for k in keys)
    on = " AND ".join(f"l.{k} = r.{k}" for k in [*keys, '"column"'])
    low = f"lo + bin * ((hi - lo) / {bins})"
    return f"""L AS ({source}), R AS (SELECT {lead}"column", min(value) AS lo, max(value) AS hi FROM L GROUP BY ALL),
B AS (SELECT {''.join(f'l.{k}, ' for k in keys)}l."column", lo, hi,
      CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END AS INTEGER) AS bin
      FROM L l JOIN R r ON {on} WHERE value IS NOT NULL)
SELECT {lead}"column", bin, {r6(low, 'low')}, {r6(f'({low}) + ((hi - lo) / {bins})', 'high')}, count(*) AS n
FROM B GROUP BY {lead}"column", bin, lo, hi"""


@query("hist_indicator", f"WITH {PANEL}, {_hist_sql(melted(list(S), 'P', 'year'), ['year'], 25)}")
def hist_indicator(spark, d):
    return rounded(profile.histogram(star.panel(spark, d, S), list(S), 25, by=["year"]))


@query("hist_by_label", f"""WITH {PANEL}, Y AS (SELECT *, CAST(CASE WHEN DEFASAGEM < 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM P),
{_hist_sql(melted(['INDE'], 'Y', 'label'), ['label'], 25)}""")
def hist_by_label(spark, d):
    return rounded(profile.histogram(target.binarize(star.panel(spark, d, ("INDE", "DEFASAGEM")), "DEFASAGEM"), ["INDE"], 25, by=["label"]))


def _box_sql(source, keys, final):
    k = ", ".join([*keys, '"column"'])
    return f"""L AS (SELECT * FROM ({source}) WHERE value IS NOT NULL),
Q AS (SELECT {k}, count(*) AS n, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM L GROUP BY ALL),
X AS (SELECT L.*, Q.* EXCLUDE ({k}), value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM L JOIN Q USING ({k}))
{final}"""


def _box_final(keys):
    k = ", ".join([*keys, '"column"'])
    return f"""SELECT {k}, max(n) AS n, {r6('max(mn)', 'min')}, {r6('min(value) FILTER (WHERE inside)', 'low_whisker')}, {r6('max(q1)', 'q1')},
{r6('max(q2)', 'median')}, {r6('max(q3)', 'q3')}, {r6('max(value) FILTER (WHERE inside)', 'high_whisker')}, {r6('max(mx)', 'max')},
count(*) FILTER (WHERE NOT inside) AS n_outliers FROM X GROUP BY {k}"""


@query("box_stats", f"WITH {PANEL}, {_box_sql(melted(list(S), 'P'), [], _box_final([]))}")
def box_stats(spark, d):
    return rounded(profile.box_stats(star.panel(spark, d, S), list(S)))


@query("box_stats_by_category", f"WITH {PANEL}, {_box_sql(melted(['INDE', 'IDA'], 'P', 'PEDRA'), ['PEDRA'], _box_final(['PEDRA']))}")
def box_stats_by_category(spark, d):
    return rounded(profile.box_stats(star.panel(spark, d, ("INDE", "IDA", "PEDRA")), ["INDE", "IDA"], by=["PEDRA"]))


_OUTSIDE = f'SELECT cust_id, year, "column", {r6("value", "value")} FROM X WHERE NOT inside'


@query("box_outliers", f"WITH {PANEL}, {_box_sql(melted(['INDE', 'IPP', 'IPV'], 'P', 'cust_id, year'), [], _OUTSIDE)}")
def box_outliers(spark, d):
    return rounded(profile.box_outliers(star.panel(spark, d, S), ["INDE", "IPP", "IPV"], [star.KEY, "year"]))


IMPUTED = names(NUMERIC)


def _filled(stat):
    return ", ".join(r6(f"coalesce({c}, (SELECT {stat}({c}) FROM W))", c) for c in IMPUTED)


@query("impute_median", f"WITH {wide(NUMERIC)} SELECT cust_id, {_filled('median')} FROM W")
def impute_median(spark, d):
    return rounded(impute.impute(star.wide(spark, d, NUMERIC), IMPUTED, "median"))


@query("impute_mean", f"WITH {wide(NUMERIC)} SELECT cust_id, {_filled('avg')} FROM W")
def impute_mean(spark, d):
    return rounded(impute.impute(star.wide(spark, d, NUMERIC), IMPUTED, "mean"))


_TEXTS = names(("PEDRA", "TURMA"))


def _mode(c):
    return f"(SELECT {c} FROM W WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", f"""WITH {wide(('PEDRA', 'TURMA'))}
SELECT cust_id, {', '.join(f'coalesce({c}, {_mode(c)}) AS {c}' for c in _TEXTS)} FROM W""")
def impute_mode(spark, d):
    return impute.impute(star.wide(spark, d, ("PEDRA", "TURMA")), _TEXTS, "mode")


_GAPS = "G AS (SELECT cust_id, year, CASE WHEN (cust_id + year) % 7 = 0 THEN NULL ELSE INDE END AS INDE, CASE WHEN cust_id % 5 = 0 THEN NULL ELSE IDA END AS IDA FROM P)"


@query("impute_median_by_year", f"""WITH {PANEL}, {_GAPS}, M AS (SELECT year, median(INDE) AS a, median(IDA) AS b FROM G GROUP BY year)
SELECT cust_id, year, {r6('coalesce(INDE, a)', 'INDE')}, {r6('coalesce(IDA, b)', 'IDA')} FROM G JOIN M USING (year)""")
def impute_median_by_year(spark, d):
    gaps = star.panel(spark, d, ("INDE", "IDA")).selectExpr(
        "cust_id", "year", "CASE WHEN (cust_id + year) % 7 = 0 THEN NULL ELSE INDE END AS INDE",
        "CASE WHEN cust_id % 5 = 0 THEN NULL ELSE IDA END AS IDA",
    )
    return rounded(impute.fitted_by_group(gaps, "year", ["INDE", "IDA"]))
