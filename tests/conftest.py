import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from tillpoint.session import local_session
    wh = tempfile.mkdtemp(prefix="tillpoint-warehouse-")
    s = local_session("4", shuffle_partitions=8, app="tillpoint-tests",
                      extra={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()
