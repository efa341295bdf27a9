from __future__ import annotations

import pytest

from souklens import build_session
from souklens.session import drop_written


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written(session)
    session.stop()


@pytest.fixture(scope="session")
def con():
    from tests.compare import connect
    return connect("/root/testdata/sf0.001")
