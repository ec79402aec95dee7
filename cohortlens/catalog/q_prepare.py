"""Encoding, scaling, splits, folds, weights and the whole preparation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.catalog.inputs import PANEL, names, wide
from cohortlens.catalog.q_features import EVERY
from cohortlens.catalog.registry import query, r6, rounded
from cohortlens.functions.labels import risk_level
from cohortlens.operators import encode, impute, scale, split, target
from cohortlens.plans import prepare, stages
from cohortlens.session import materialize, scratch_dir
from cohortlens.sources import star

S = C.SCORE_INDICATORS


def ordinal_sql(c):
    return f"CASE WHEN {c} = 'Quartzo' THEN 1 WHEN {c} IN ('Ágata', 'Agata') THEN 2 WHEN {c} = 'Ametista' THEN 3 " \
           f"WHEN {c} IN ('Topázio', 'Topazio') THEN 4 ELSE 0 END"


@query("ordinal_encode", f"""WITH {wide(('PEDRA',))}
SELECT cust_id, {', '.join(f'CAST({ordinal_sql(f"PEDRA_{y}")} AS INTEGER) AS PEDRA_{y}' for y in star.YEARS)} FROM W""")
def ordinal_encode(spark, d):
    df = star.wide(spark, d, ("PEDRA",))
    return encode.ordinal(df, encode.ordinal_columns(df))


_CATALOG = """K AS (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM customer GROUP BY 2
  UNION ALL SELECT 'c_name', c_name FROM customer GROUP BY 2),
E AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS index FROM K)"""
_NOMINAL = ["c_mktsegment", "c_name"]


@query("label_catalog", f'WITH {_CATALOG} SELECT "column", value, index FROM E')
def label_catalog(spark, d):
    return encode.catalog(star.table(spark, d, "customer"), _NOMINAL)


@query("label_encode", f"""WITH {_CATALOG}
SELECT c_custkey, s.index AS c_mktsegment, n.index AS c_name FROM customer c
JOIN E s ON s."column" = 'c_mktsegment' AND s.value = c.c_mktsegment JOIN E n ON n."column" = 'c_name' AND n.value = c.c_name""")
def label_encode(spark, d):
    people = star.table(spark, d, "customer").select("c_custkey", *_NOMINAL)
    return encode.apply(people, encode.catalog(people, _NOMINAL), _NOMINAL)


# Classes are learned from events before the middle of the month, without one event type.
_LEARN = "ts < TIMESTAMP '2024-01-16' AND event_type <> 'error'"
_SEEN = f"""K AS (SELECT event_type AS seen, row_number() OVER (ORDER BY event_type) - 1 AS index
FROM (SELECT DISTINCT event_type FROM events WHERE {_LEARN}))"""


@query("label_transform_unseen", f"""WITH {_SEEN}
SELECT event_id, coalesce(index, -1) AS event_type FROM events LEFT JOIN K ON seen = event_type""")
def label_transform_unseen(spark, d):
    events = star.table(spark, d, "events")
    classes = encode.catalog(events.where(_LEARN.replace("TIMESTAMP ", "timestamp_ntz")), ["event_type"])
    return encode.apply(events.select("event_id", "event_type"), classes, ["event_type"])


@query("label_transform_batch", f"""WITH {_SEEN}, T AS (SELECT event_id, coalesce(index, -1) AS i FROM events LEFT JOIN K ON seen = event_type)
SELECT event_id, CASE WHEN (SELECT min(i) FROM T) < 0 THEN 0 ELSE i END AS event_type FROM T""")
def label_transform_batch(spark, d):
    events = star.table(spark, d, "events")
    classes = encode.catalog(events.where(_LEARN.replace("TIMESTAMP ", "timestamp_ntz")), ["event_type"])
    return encode.apply_like_batch(events.select("event_id", "event_type"), classes, ["event_type"])


_ROWS = f"""{PANEL}, Y AS (SELECT cust_id * 10000 + year AS row_key, INDE, IDA,
CAST(CASE WHEN DEFASAGEM < 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM P)"""


def split_sql(source, key, label, extra=""):
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || CAST({key} AS VARCHAR)), {key})
 <= floor(count(*) OVER (PARTITION BY {label}) * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split {extra} FROM {source}"""


def _labelled_rows(spark, d):
    df = target.binarize(star.panel(spark, d, ("INDE", "IDA", "DEFASAGEM")), "DEFASAGEM")
    rows = df.select((F.col("cust_id") * 10000 + F.col("year")).alias("row_key"), "INDE", "IDA", "label")
    return materialize(rows, "rows")  # a split reads its rows more than once


@query("stratified_split", f"WITH {_ROWS}, Z AS ({split_sql('Y', 'row_key', 'label')}) SELECT row_key, label, split FROM Z")
def stratified_split(spark, d):
    return split.stratified(_labelled_rows(spark, d).select("row_key", "label"), "label", "row_key")


@query("hash_split", f"""WITH {_ROWS}
SELECT row_key, CASE WHEN substr(md5('42|' || CAST(row_key AS VARCHAR)), 1, 12) < '{int(0.2 * 16**12):012x}' THEN 'test' ELSE 'train' END AS split
FROM Y""")
def hash_split(spark, d):
    return split.by_hash(_labelled_rows(spark, d).select("row_key"), "row_key")


_RANKED = """Z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(row_key AS VARCHAR)), row_key) AS r,
count(*) OVER (PARTITION BY label) AS n FROM Y)"""
_FOLD = " + ".join(f"CASE WHEN r <= floor(n * {i / 5!r}::DOUBLE + 0.5) THEN 0 ELSE 1 END" for i in range(1, 5))


@query("stratified_folds", f"WITH {_ROWS}, {_RANKED} SELECT row_key, label, CAST({_FOLD} AS INTEGER) AS fold FROM Z")
def stratified_folds(spark, d):
    return split.folds(_labelled_rows(spark, d).select("row_key", "label"), "label", "row_key", 5)


_SCALED = f"{_ROWS}, Z AS ({split_sql('Y', 'row_key', 'label')})"


@query("scale_fit", f"WITH {_SCALED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'std')} FROM Z WHERE split = 'train'" for c in ("INDE", "IDA")))
def scale_fit(spark, d):
    rows = split.stratified(_labelled_rows(spark, d), "label", "row_key")
    return rounded(scale.fit(rows.where("split = 'train'"), ["INDE", "IDA"]))


@query("scale_apply", f"""WITH {_SCALED}, M AS (SELECT avg(INDE) AS am, stddev_pop(INDE) AS asd, avg(IDA) AS bm, stddev_pop(IDA) AS bsd
FROM Z WHERE split = 'train')
SELECT row_key, split, {r6('(INDE - am) / CASE WHEN asd = 0 THEN 1 ELSE asd END', 'INDE')},
{r6('(IDA - bm) / CASE WHEN bsd = 0 THEN 1 ELSE bsd END', 'IDA')} FROM Z, M""")
def scale_apply(spark, d):
    rows = split.stratified(_labelled_rows(spark, d), "label", "row_key")
    stats = scale.fit(rows.where("split = 'train'"), ["INDE", "IDA"])
    return rounded(scale.apply(rows.drop("label"), stats, ["INDE", "IDA"]))


@query("class_weights", f"""WITH {_ROWS}
SELECT label, count(*) AS n, {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} FROM Y GROUP BY label""")
def class_weights(spark, d):
    return rounded(target.class_weights(_labelled_rows(spark, d), "label"))


@query("risk_level_label", f"""WITH {PANEL}
SELECT cust_id, year, CASE WHEN DEFASAGEM < 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM P""")
def risk_level_label(spark, d):
    df = target.binarize(star.panel(spark, d, ("DEFASAGEM",)), "DEFASAGEM")
    return df.select("cust_id", "year", risk_level(F.col("label")).alias("risk_level"))


# The whole preparation of all columns and years.
_NUM = names([c for c in star.YEARLY if c not in (C.ORDINAL, C.GROUP, C.TARGET)])
_ORD = names((C.ORDINAL,))
_NOM = names((C.GROUP,))


def _mode(c):
    return f"(SELECT {c} FROM TR WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def prep_sql(rows: str, keep: str) -> str:
    """Fill, encode and scale `rows` with the statistics of the training rows TR."""
    filled = ", ".join(
        [f"coalesce({c}, (SELECT median({c}) FROM TR)) AS {c}" for c in _NUM] + [f"coalesce({c}, {_mode(c)}) AS {c}" for c in (*_ORD, *_NOM)]
    )
    coded = ", ".join(
        [f"CAST({c} AS DOUBLE) AS {c}" for c in _NUM] + [f"CAST({ordinal_sql(c)} AS DOUBLE) AS {c}" for c in _ORD]
        + [f"CAST(coalesce((SELECT count(*) FROM C_{c} k WHERE k.v < f.{c} AND f.{c} IN (SELECT v FROM C_{c})), -1) AS DOUBLE) AS {c}" for c in _NOM]
    )
    coded += "".join(f", CAST({expression} AS DOUBLE) AS {name}" for name, expression in EVERY)
    made = (*_NUM, *_ORD, *_NOM, *[name for name, _ in EVERY])
    moments = ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in made)
    scaled = ", ".join(r6(f"({c} - a_{c}) / s_{c}", c) for c in made)
    lists = ", ".join(f"C_{c} AS (SELECT DISTINCT {c} AS v FROM TF)" for c in _NOM)
    return f"""{wide()},
Y AS (SELECT *, CAST(CASE WHEN DEFASAGEM_2001 < 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM W WHERE DEFASAGEM_2001 IS NOT NULL),
Z AS ({split_sql('Y', 'cust_id', 'label')}),
TR AS (SELECT * FROM Z WHERE split = 'train'),
TF AS (SELECT {filled} FROM TR), {lists},
TC AS (SELECT {coded} FROM TF f),
RF AS (SELECT {keep}, {filled} FROM {rows}),
RC AS (SELECT {keep}, {coded} FROM RF f),
MO AS (SELECT {moments} FROM TC)
SELECT {keep}, {scaled} FROM RC, MO"""


@query("prep_rows", "WITH " + prep_sql("Z", "cust_id, label, split"))
def prep_rows(spark, d):
    df = star.wide(spark, d)
    matrix, _ = prepare.prepare(df, star.wide_spec(df))
    return rounded(matrix)


@query("prep_pipeline", "WITH " + prep_sql("Z", "cust_id, label, split"))
def prep_pipeline(spark, d):
    """The same preparation as a saved and loaded `Pipeline`, fitted on the training rows."""
    df = star.wide(spark, d)
    spec = star.wide_spec(df)
    keep = [spec.key, prepare.LABEL, prepare.SPLIT]
    rows = split.stratified(materialize(prepare.labelled(df, spec), "labelled"), prepare.LABEL, spec.key)
    steps, columns = stages.stages(rows, spec, keep)
    path = scratch_dir(spark, "prep-pipeline")
    Pipeline(stages=steps).fit(rows.where("split = 'train'")).write().save(path)
    return rounded(PipelineModel.load(path).transform(rows).select(*keep, *columns))


@query("score_prepare", "WITH " + prep_sql("(SELECT * FROM W WHERE DEFASAGEM_2001 IS NULL)", "cust_id"))
def score_prepare(spark, d):
    df = star.wide(spark, d)
    spec = star.wide_spec(df)
    _, prep = prepare.prepare(df, spec)
    return rounded(prep.transform(df.where("DEFASAGEM_2001 IS NULL"), [star.KEY]))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*_NUM, *_ORD, *_NOM))


@query("prep_rows_drop", "WITH " + prep_sql("Z", "cust_id, label, split").replace(
    f"AS label FROM W WHERE {C.TARGET}_{star.LATEST} IS NOT NULL", f"AS label FROM W WHERE {C.TARGET}_{star.LATEST} IS NOT NULL AND {_COMPLETE}"))
def prep_rows_drop(spark, d):
    """The preparation on rows without a gap."""
    df = star.wide(spark, d)
    matrix, _ = prepare.prepare(df, star.wide_spec(df), missing="drop")
    return rounded(matrix)


_NUMBERS = [*_NUM, *names((C.TARGET,))]


@query("impute_all", f"""WITH {wide()}
SELECT cust_id, {', '.join(r6(f'coalesce({c}, (SELECT median({c}) FROM W))', c) for c in _NUMBERS)},
       {', '.join(f'coalesce({c}, (SELECT {c} FROM W WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}' for c in (*_ORD, *_NOM))} FROM W""")
def impute_all(spark, d):
    return rounded(impute.impute_all(star.wide(spark, d), keep=(star.KEY,)))
