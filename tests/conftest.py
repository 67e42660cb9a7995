import pytest

from lumigrid.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", 4, spark__driver__memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
