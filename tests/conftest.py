import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rememora.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # the driver of a local session runs the tasks too
    session = build_session("local[8]", shuffle_partitions=4, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL
