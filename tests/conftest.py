import tempfile

import pytest

from plurivox.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="plurivox-test-"), spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
