import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fairplay.session import local_session

    s = local_session("8", shuffle_partitions=8, app="fairplay-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    from fairplay.plans.verify import duckdb_connection

    return duckdb_connection(SF_CHECK)
