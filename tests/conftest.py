import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checks.compare import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def study(spark):
    from checks.context import Study

    return Study(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    from checks.compare import connect

    return connect(SMALL)
