"""Panels and logs derived from the order, event, label and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens import constants as C
from cohortlens.operators.panel import to_wide
from cohortlens.spec import PanelSpec

KEY = "cust_id"
YEARS = tuple(range(1995, 2002))  # the years of the given order tables
LATEST = YEARS[-1]

# Columns of the yearly panel, in table order.
YEARLY = (
    *C.SCORE_INDICATORS, C.TARGET, C.TURNING_POINT, C.PHASE, C.AGE, C.ORDINAL, C.GROUP, C.SCHOLARSHIP, C.TENURE,
)


# Column types of the input tables. Naming them saves a job per table that would read file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def whole(x: str) -> str:
    """`cast(round(x) AS bigint)` of a double as SQL text. `round` goes by way of decimals, so it is left to the ties, which `rint` puts on the even side."""
    return f"CASE WHEN abs({x} - rint({x})) = 0.5D THEN cast(round({x}) AS bigint) ELSE cast(rint({x}) AS bigint) END"


def panel(spark: SparkSession, folder: str, columns=YEARLY) -> DataFrame:
    """Long panel: one row per customer and year with at least one order that has lines, all years there are.

    Lines shrink to one row per order before they meet the orders, so both sides of that join share
    the partitioning by order key. All sums are of integers and come out the same in any order.
    First years and customers are joined only for columns that need them.
    """
    orders = table(spark, folder, "orders")
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"sum({whole('l_discount * 100')}) AS sd"),
            F.expr(f"sum({whole('l_tax * 100')}) AS st"),
            F.expr(f"sum({whole('l_quantity')}) AS sq"),
            F.expr("count_if(l_returnflag = 'R') AS nr"),
            F.expr("count_if(l_returnflag = 'A') AS na"),
        )
    )
    sums = (
        orders.join(per_order, "o_orderkey")
        .groupBy(F.expr(f"o_custkey AS {KEY}"), F.expr("year(o_orderdate) AS year"))
        .agg(
            F.expr("count(1) AS orders"),
            F.expr(f"sum({whole('o_totalprice * 100')}) AS cents"),
            *[F.sum(c).alias(c) for c in ("n", "sd", "st", "sq", "nr", "na")],
            F.expr("count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent"),
            F.expr("max(if(o_orderstatus = 'F', 1, 0)) AS any_f"),
            F.expr("bit_count(bit_or(shiftleft(1, month(o_orderdate) - 1))) AS months"),
        )
    )
    joined = sums
    if C.TENURE in columns:
        firsts = orders.groupBy(F.expr(f"o_custkey AS {KEY}")).agg(F.expr("year(min(o_orderdate)) AS first_year"))
        joined = joined.join(firsts, KEY)
    if C.GROUP in columns or C.SCHOLARSHIP in columns:
        people = table(spark, folder, "customer").selectExpr(f"c_custkey AS {KEY}", "c_mktsegment", "c_acctbal")
        joined = joined.join(people, KEY)
    scored = joined.selectExpr("*", "least(10.0D, cast(cents AS double) / (5000000 * orders)) AS INDE")
    formulas = {
        "INDE": "INDE",
        "IAA": "least(10.0D, cast(sd AS double) / n)",
        "IEG": "least(10.0D, cast(2 * orders AS double))",
        "IPS": "least(10.0D, cast(125 * st AS double) / (100 * n))",
        "IDA": "cast(sq AS double) / (5 * n)",
        "IPP": "cast(10 * urgent AS double) / orders",
        "IPV": "cast(10 * (n - nr) AS double) / n",
        C.TARGET: "cast(na - nr AS int)",
        C.TURNING_POINT: "any_f",
        C.PHASE: "cast(least(8, months) AS int)",
        C.AGE: f"cast(7 + {KEY} % 11 + (year - {YEARS[0]}) AS int)",
        C.ORDINAL: "CASE WHEN INDE < 2.5D THEN 'Quartzo' WHEN INDE < 5 THEN 'Ágata' WHEN INDE < 7.5D THEN 'Ametista' "
        "ELSE 'Topázio' END",
        C.GROUP: "c_mktsegment",
        C.SCHOLARSHIP: "if(c_acctbal < 0, 1, 0)",
        C.TENURE: "year - first_year",
    }
    return scored.selectExpr(KEY, "year", *[f"{formulas[c]} AS {c}" for c in columns])


def order_years(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """Every year from the first order to the last."""
    first, last = table(spark, folder, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).head()
    return tuple(range(first.year, last.year + 1))


def wide(spark: SparkSession, folder: str, columns=YEARLY, years=YEARS) -> DataFrame:
    """The panel as one row per customer, columns {name}_{year}; customers without orders stay, as nulls.

    `years=None` takes the years of the orders; naming them saves a pass over the dates.
    """
    years = years or order_years(spark, folder)
    people = table(spark, folder, "customer").selectExpr(f"c_custkey AS {KEY}")
    pivoted = to_wide(panel(spark, folder, columns).where(F.col("year").isin(*years)), KEY, "year", years, columns)
    return people.join(pivoted, KEY, "left")


def wide_spec(df: DataFrame) -> PanelSpec:
    return PanelSpec.from_schema(df.schema, KEY, year_range=(1990, 2030))


def score_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a prediction log."""
    return as_score_log(table(spark, folder, "events"))


def as_score_log(events: DataFrame) -> DataFrame:
    p = F.col("value") / (F.col("value") + 100.0)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "user_id",
        F.col("props").alias("input_data"),
        F.when(p >= 0.5, 1).otherwise(0).cast("int").alias("prediction"),
        F.when(p >= 0.5, "HIGH").otherwise("LOW").alias("risk_level"),
        p.alias("probability_at_risk"),
        F.col("event_type").alias("model_type"),
    )


def labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labels joined to documents: y_true, y_proba, y_pred. The texts are never read."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    p = F.col("n_chars") / (F.col("n_chars") + 3000.0)
    return (
        table(spark, folder, "labels")
        .join(documents, "doc_id")
        .select(
            "doc_id",
            F.col("quality").cast("int").alias("y_true"),
            p.alias("y_proba"),
            F.when(p >= 0.5, 1).otherwise(0).cast("int").alias("y_pred"),
        )
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as an ML input: an array of features and a binary label."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 2).cast("int").alias("label")
    )
