import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from stratum.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4)
    yield s
    s.stop()
