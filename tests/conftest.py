import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from lectern.session import build_session

    session = build_session("tests", cpus=4, partitions=3)
    yield session
    session.stop()
