import pytest

from flowloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "flowloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
