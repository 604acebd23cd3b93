import pytest

from quillon.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, app="quillon-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
