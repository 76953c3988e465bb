import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from awkward import CLASHES, SCHEMA, awkward_rows  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
