import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_rows import EDGE, rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return rows(spark, EDGE).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return rows(spark, [])
