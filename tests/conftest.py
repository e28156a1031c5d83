import pytest

from barlake.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
