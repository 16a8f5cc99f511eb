import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark():
    from siftwork.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "8"), "siftwork-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
