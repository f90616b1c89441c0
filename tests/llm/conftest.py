from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]


@pytest.fixture(scope="session")
def odd(spark):
    from llm_cases import KIND, odd_rows

    return spark.createDataFrame(odd_rows(), KIND).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    from llm_cases import KIND

    return spark.createDataFrame([], KIND)
