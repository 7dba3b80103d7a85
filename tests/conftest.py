import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, 8, "8g")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    def make(**texts):
        rows = [(path.replace("__", "/").replace("_DOT_", "."), text) for path, text in texts.items()]
        return spark.createDataFrame(rows, "path string, content string")
    return make
