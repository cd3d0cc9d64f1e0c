import pytest

from parley.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "parley-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
