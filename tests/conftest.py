import os

import pytest

os.environ.setdefault("CODESTRATA_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import get_session

    session = get_session(cpus=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
