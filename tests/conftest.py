from __future__ import annotations

import os
import sys
from pathlib import Path

# Small matrices: threads of the linear algebra would only compete with Spark's.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import BROADCAST_ROWS, HOT_ROWS, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(spark):
    """Every group above 20 rows is hot."""
    spark.conf.set(HOT_ROWS[0], "20")
    yield
    spark.conf.unset(HOT_ROWS[0])


@pytest.fixture
def no_broadcast(spark):
    """Tables above 3 rows are joined by shuffle."""
    spark.conf.set(BROADCAST_ROWS[0], "3")
    yield
    spark.conf.unset(BROADCAST_ROWS[0])
