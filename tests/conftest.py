import os
import tempfile

import pytest

ROOT = os.environ.get("QUILLSTONE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import session

    folder = tempfile.mkdtemp()
    s = session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"{folder}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    path = f"{ROOT}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the supplied tables are not here")
    return path
