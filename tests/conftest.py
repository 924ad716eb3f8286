import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for the Python workers
os.environ["TZ"] = "UTC"
time.tzset()

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from brookmill.session import build_session

    session = build_session("tests", master="local[2]", shuffle_partitions=2, **{"spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
