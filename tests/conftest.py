import pytest


@pytest.fixture(scope="session")
def spark():
    from skein.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
