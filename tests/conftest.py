import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from starslice.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def star(spark, sf_dir):
    from starslice.sources import driver_tables as D

    return D.settled(spark, sf_dir, "fact", "dim", "attrs", "effort")


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    return df.collect()[0][0]
