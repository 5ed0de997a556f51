import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from allelespan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("allelespan-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Small table from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
