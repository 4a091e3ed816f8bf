import pytest

from skeinlake.plans.staging import cleanup
from skeinlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", partitions=4, memory="6g")
    yield session
    cleanup(session)
    session.stop()
