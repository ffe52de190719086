import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def spark():
    from skyspine.session import local_session
    session = local_session("8", shuffle_partitions=8, app="tests")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh folder for one test; none is removed."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of one- or many-column rows."""
    def run(build, rows, ddl="x STRING"):
        data = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i INT, " + ddl)
        return [r[1] for r in df.select("i", build(df).alias("y")).orderBy("i").collect()]
    return run
