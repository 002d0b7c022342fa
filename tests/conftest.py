import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from riskcohort.session import local_session

    session = local_session("tests", partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables")
    return str(path)
