import pytest

from pulsegrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, partitions=4)
    yield session
    session.stop()
