"""The panel, log and label inputs of the registered queries as DuckDB text."""

from __future__ import annotations

from cohortlens.sources.star import YEARLY, YEARS

# Long panel P, one row per customer and year.
PANEL = """
per_order AS (
  SELECT l_orderkey, count(*) AS n,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS sd, sum(CAST(round(l_tax * 100) AS BIGINT)) AS st,
         sum(CAST(round(l_quantity) AS BIGINT)) AS sq,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS nr,
         sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS na
  FROM lineitem GROUP BY l_orderkey),
sums AS (
  SELECT o_custkey AS cust_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(n) AS BIGINT) AS n, CAST(sum(sd) AS BIGINT) AS sd, CAST(sum(st) AS BIGINT) AS st,
         CAST(sum(sq) AS BIGINT) AS sq, CAST(sum(nr) AS BIGINT) AS nr, CAST(sum(na) AS BIGINT) AS na,
         CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS urgent,
         max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_f,
         count(DISTINCT month(o_orderdate)) AS months
  FROM orders JOIN per_order ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
firsts AS (SELECT o_custkey AS cust_id, min(CAST(year(o_orderdate) AS INTEGER)) AS first_year FROM orders GROUP BY 1),
scored AS (
  SELECT s.*, first_year, c_mktsegment, c_acctbal,
         least(10.0::DOUBLE, CAST(cents AS DOUBLE) / (5000000 * orders)) AS INDE
  FROM sums s JOIN firsts USING (cust_id) JOIN customer ON c_custkey = cust_id),
P AS (
  SELECT cust_id, year, INDE,
         least(10.0::DOUBLE, CAST(sd AS DOUBLE) / n) AS IAA,
         least(10.0::DOUBLE, CAST(2 * orders AS DOUBLE)) AS IEG,
         least(10.0::DOUBLE, CAST(125 * st AS DOUBLE) / (100 * n)) AS IPS,
         CAST(sq AS DOUBLE) / (5 * n) AS IDA,
         CAST(10 * urgent AS DOUBLE) / orders AS IPP,
         CAST(10 * (n - nr) AS DOUBLE) / n AS IPV,
         CAST(na - nr AS INTEGER) AS DEFASAGEM,
         CAST(any_f AS INTEGER) AS PONTO_VIRADA,
         CAST(least(8, months) AS INTEGER) AS FASE,
         CAST(7 + cust_id % 11 + (year - 1995) AS INTEGER) AS IDADE_ALUNO,
         CASE WHEN INDE < 2.5 THEN 'Quartzo' WHEN INDE < 5 THEN 'Ágata' WHEN INDE < 7.5 THEN 'Ametista'
              ELSE 'Topázio' END AS PEDRA,
         c_mktsegment AS TURMA,
         CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS BOLSISTA,
         CAST(year - first_year AS INTEGER) AS ANOS_PM
  FROM scored)"""

# Prediction log.
LOG = """
EV AS (
  SELECT event_id AS id, ts AS timestamp, user_id, props AS input_data,
         CAST(CASE WHEN value / (value + 100.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
         CASE WHEN value / (value + 100.0::DOUBLE) >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
         value / (value + 100.0::DOUBLE) AS probability_at_risk, event_type AS model_type
  FROM events)"""

# The same log with a shifted second half.
SHIFTED = """
SH AS (
  SELECT ts, user_id, event_type,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE value * 3 END
         / (CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE value * 3 END + 100.0::DOUBLE) AS p,
         ts < TIMESTAMP '2024-01-16' AS is_ref
  FROM events)"""

# Labelled scores.
LABELS = """
LB AS (
  SELECT doc_id, CAST(quality AS INTEGER) AS y_true, n_chars / (n_chars + 3000.0::DOUBLE) AS y_proba,
         CAST(CASE WHEN n_chars / (n_chars + 3000.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS y_pred
  FROM labels JOIN documents USING (doc_id))"""


def wide(columns=YEARLY, years=YEARS) -> str:
    """W: the panel with a column per name and year."""
    cells = ", ".join(f"max(CASE WHEN year = {y} THEN {c} END) AS {c}_{y}" for c in columns for y in years)
    return f"{PANEL},\nW AS (SELECT c_custkey AS cust_id, {cells} FROM customer LEFT JOIN P ON cust_id = c_custkey GROUP BY 1)"


def names(columns, years=YEARS) -> list[str]:
    return [f"{c}_{y}" for c in columns for y in years]


def melted(columns: list[str], source: str = "W", ids: str = "") -> str:
    """(ids, column, value) rows with doubles, nulls kept."""
    lead = f"{ids}, " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )
