import pytest

from arborframe.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
