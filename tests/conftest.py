import pytest

from rollframe import runtime


@pytest.fixture(scope="session")
def spark():
    s = runtime.get_spark("tests", cores=4, shuffle=4)
    yield s
    s.stop()
