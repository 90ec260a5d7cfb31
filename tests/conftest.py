import pytest

from sievework.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", partitions=4, memory="4g")
    yield s
    s.stop()
