import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("CORPUSLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.plans.session import local_session

    os.environ.setdefault("CORPUSLOOM_DRIVER_MEMORY", "4g")
    session = local_session("tests", cores="4", partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
