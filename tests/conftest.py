import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionsift.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=4, app="sessionsift-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sessionsift-test-ckpt-"))
    yield s


@pytest.fixture()
def df(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
