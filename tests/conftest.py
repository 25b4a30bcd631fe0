import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracklore.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("8", partitions=4, memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
