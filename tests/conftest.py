import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallywire.session import local_session  # noqa: E402
from tallywire.streaming.timers import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield session
    session.stop()
