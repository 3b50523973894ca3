import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import HOT_BLOCKS_SETTING, HOT_ROWS_SETTING, local_session  # noqa: E402

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tidemark-tests")


@pytest.fixture
def hot(spark):
    """Split keys with more than a few rows into blocks."""
    spark.conf.set(HOT_ROWS_SETTING, "5")
    spark.conf.set(HOT_BLOCKS_SETTING, "7")
    yield
    spark.conf.unset(HOT_ROWS_SETTING)
    spark.conf.unset(HOT_BLOCKS_SETTING)


@pytest.fixture(scope="session")
def data():
    return DATA
