import pytest

from mergestone.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__session__timeZone="UTC")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
