import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marketflow.session import get_spark
    s = get_spark("local[4]", app_name="marketflow-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def scratch():
    """A fresh local folder per test (tests only; jobs use the checkpoint dir)."""
    return tempfile.mkdtemp(prefix="mf-test-")
