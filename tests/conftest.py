import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from pulse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame of literal rows."""

    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    return make


@pytest.fixture
def rows():
    """Collected rows as a set of tuples in the order of the named columns."""

    def read(df, *names):
        names = names or df.columns
        return sorted(tuple(r[n] for n in names) for r in df.collect())

    return read
