import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from carelens.session import get_session
    scratch = tempfile.mkdtemp(prefix="carelens-test-")
    s = get_session(master="local[8]", shuffle_partitions=8, extra={
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.local.dir": scratch, "spark.driver.memory": "8g"})
    yield s
    s.stop()
