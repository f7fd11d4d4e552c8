import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import harness  # noqa: E402

from tidemark import layout  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return harness.session(4)


@pytest.fixture()
def split(spark):
    """Force the chunked layout with tiny chunks."""
    spark.conf.set(layout.CHUNK_ROWS_CONF, "16")
    spark.conf.set(layout.WHOLE_ROWS_CONF, "30")
    yield spark
    spark.conf.unset(layout.CHUNK_ROWS_CONF)
    spark.conf.unset(layout.WHOLE_ROWS_CONF)
