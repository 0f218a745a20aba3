import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rankloom.session import get_session
    wh = tempfile.mkdtemp(prefix="rankloom-wh-")
    s = get_session("local[4]", 4, extra={"spark.driver.memory": "8g", "spark.sql.warehouse.dir": wh})
    yield s


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
