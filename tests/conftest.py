import os

import pytest

from sitelark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    cores = min(8, os.cpu_count() or 2)
    session = local_session(cores, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()
