import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).parent))

from llm_rows import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
