import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from auditlake.session import local_session  # noqa: E402

HERE = os.path.dirname(os.path.abspath(__file__))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", shuffle_partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog_dir():
    return os.path.join(HERE, "catalog")


@pytest.fixture(scope="session")
def registry_path():
    return os.path.join(HERE, "regulations.json")
