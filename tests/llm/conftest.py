import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows in several partitions."""
    return spark.createDataFrame(cases.hard_rows(), cases.SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)
