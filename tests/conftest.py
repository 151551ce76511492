import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.session import ROWS_PER_SLICE_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "sliced"])
def slicing(request, spark):
    """Run a test once with plain windows and once with tiny range slices."""
    if request.param == "sliced":
        spark.conf.set(ROWS_PER_SLICE_KEY, "300")
    yield request.param
    spark.conf.unset(ROWS_PER_SLICE_KEY)
