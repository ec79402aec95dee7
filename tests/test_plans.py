"""Plans: no cross joins, no Python steps, only the needed columns, filters at the scan."""

import os

import pytest

from cohortlens.catalog import QUERIES
from cohortlens.sources import star

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def plan(df, form="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), form)


@pytest.mark.parametrize("name", [
    "batch_score_summary", "feat_all", "corr_matrix", "drift_report", "roc_curve", "stratified_split", "label_encode",
    "dq_contract_violations", "impute_median_by_year", "score_prepare", "monitoring_summary", "sessions_batch",
])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas") if w in text]


def test_scans_read_only_what_is_used(spark):
    text = plan(star.panel(spark, SF, ("INDE", "IAA")))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    lines = next(s for s in schemas if "l_orderkey" in s)
    assert "l_shipdate" not in lines and "l_tax" not in lines and "l_quantity" not in lines
    assert not any("c_custkey" in s for s in schemas)


def test_texts_are_never_read(spark):
    text = plan(star.labelled_scores(spark, SF))
    assert not any("text:string" in line for line in text.splitlines() if line.startswith("ReadSchema"))
