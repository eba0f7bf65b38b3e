import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from credrisk.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="credrisk-tests")
    yield s


@pytest.fixture(scope="session")
def duck_smoke():
    from oracle_util import duck
    return duck(SMOKE)
