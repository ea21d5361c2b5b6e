import pytest

from tests.compare import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()
