import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sparkrisk.session import local_session
    s = local_session(4, shuffle_partitions=8, app="sparkrisk-tests")
    yield s
    s.stop()
