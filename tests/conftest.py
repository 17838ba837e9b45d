import pytest

from folioweave.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session(4, shuffle_partitions=4, driver_memory="4g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
