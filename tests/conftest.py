import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = local_session(4, shuffle_partitions=4, memory="6g", settings=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """Make an hourly frame (respondent, period, value) from {code: [values]}."""
    from datetime import datetime, timedelta

    def make(series: dict, start=datetime(2022, 1, 1), name="value", step=timedelta(hours=1)):
        rows = [(k, start + i * step, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, f"respondent string, period timestamp_ntz, {name} double")

    return make
