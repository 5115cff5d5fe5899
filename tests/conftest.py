import pytest

from tidewright.common import release, session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release()
