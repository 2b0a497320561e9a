import pytest

from pairlight.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
