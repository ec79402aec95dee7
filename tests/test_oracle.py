"""Every query with a SQL form agrees with DuckDB on the smallest tables; the others return rows."""

import os

import pytest

import __spark_entry__ as entry_points
from check_oracle import compare, connect
from cohortlens import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: Queries of the panel part whose last step runs Python: very many correlations.
PYTHON = {"corr_pairwise_nulls"}


@pytest.mark.parametrize("name", sorted(n for n in entry_points.queries() if n in entry_points.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    frames = []
    ok, _, _, message = compare(spark, con, SF, name, frames)
    assert ok, message
    if name in catalog.QUERIES:
        text = spark._jvm.PythonSQLUtils.explainString(frames[0]._jdf.queryExecution(), "simple")
        assert "CartesianProduct" not in text and (name in PYTHON or not any(w in text for w in ("EvalPython", "MapIn", "InPandas", "InArrow")))


def test_every_statement_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    row = entry_points.entry(spark).head()
    assert row["total"] == row["n_high"] + row["n_low"] > 0
