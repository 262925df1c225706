import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wavecrawl.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="wavecrawl-tests")
    yield s
    s.stop()


SF_DIR = os.environ.get("WAVECRAWL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
