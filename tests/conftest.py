import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sourceloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named strings."""
    def value(build, **row):
        frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
        return frame.select(build.alias("v")).first().v

    return value
