import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sinter.session import get_session
    s = get_session("local[4]", app="sinter-tests", shuffle_partitions=4,
                    conf={"spark.driver.memory": "8g"})
    yield s
    s.stop()
