import pytest

from riskgrove.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(app="riskgrove-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
