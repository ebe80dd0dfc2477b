from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from breachlens.session import build_session  # noqa: E402


INTERPRETED = {
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.codegen.factoryMode": "NO_CODEGEN",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", shuffle_partitions=2,
        extra={
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            # Compiling code takes far longer than running it on a few rows.
            **INTERPRETED,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
