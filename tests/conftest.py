import pytest

from stichos.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
