import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barweave.session import local_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "barweave-tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    shared_dir(session)
    yield session
