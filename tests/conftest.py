import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from lithoscope.session import build_session

    s = build_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("LITHOSCOPE_SMALL", "/root/testdata/sf0.001")
