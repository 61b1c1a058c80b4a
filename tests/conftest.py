import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from clausespark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest given tables."""
    return SMALL


@pytest.fixture
def one(spark):
    """Value of a Column expression over literals."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
