import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=8, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series():
    """Two sessions of different length as (session_id, sample_idx, x) rows, in scrambled order."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for session, n in (("a", 61), ("b", 24)):
        x = np.round(rng.normal(size=n).cumsum(), 1)
        rows += [(session, i, float(v)) for i, v in enumerate(x)]
    rng.shuffle(rows)
    return [(str(s), int(i), float(v)) for s, i, v in rows]


@pytest.fixture
def signal(spark, series):
    return spark.createDataFrame(series, "session_id string, sample_idx bigint, x double").repartition(3)
