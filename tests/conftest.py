import pytest

from lumenspec.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, **{"spark.sql.files.maxPartitionBytes": "1m"})
