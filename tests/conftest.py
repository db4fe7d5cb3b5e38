import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tickloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session()
    yield s
    s.stop()


@pytest.fixture
def blocks(spark):
    """Force the block layout with few rows per block."""
    spark.conf.set("spark.tickloom.blockRows", "64")
    yield 64
    spark.conf.unset("spark.tickloom.blockRows")
