import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cubeframe.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
