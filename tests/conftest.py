import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import build_session, clear_scratch  # noqa: E402
from helpers import LIGHT, NOW  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a double, b string", (1.0, "x"), ...)"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="session")
def panel(spark):
    from cohortlens.sources import synthetic

    return synthetic.generate(spark, 400)


@pytest.fixture(scope="session")
def spec(panel):
    from cohortlens.spec import PanelSpec

    return PanelSpec.from_schema(panel.schema, "row_id", target_mode="already_binary")


@pytest.fixture(scope="session")
def trained(spark, panel, spec, tmp_path_factory):
    """(output folder, outcome) of a small training job."""
    from cohortlens.plans.training import TrainJob

    out = str(tmp_path_factory.mktemp("job"))
    grids = {"LogisticRegression": {"C": (0.1, 1.0)}}
    job = TrainJob(spark, spec, out, model="LogisticRegression", folds=2, grids=grids, settings=LIGHT, timestamp=NOW)
    return out, job.run(panel)
