from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugelab.storage import local_session  # noqa: E402

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    from gaugelab.plans.bindings import sensors

    return sensors(spark, SMALL_DIR).cache()
