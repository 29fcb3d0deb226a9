import pytest

from deflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
