import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakewright.session import session

    s = session(cores=4, shuffle_partitions=4, **{"spark.checkpoint.dir": "file:///tmp/checkpoints/lakewright-tests", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file:///tmp/checkpoints/lakewright-tests")
    yield s
    s.stop()
