import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from codeskein.session import local_session, ship_package

    session = local_session("tests", 8, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    ship_package(session)
    yield session
    session.stop()
