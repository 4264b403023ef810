import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import SCHEMA, TEXTS, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark, data_dir):
    return lambda name: spark.read.parquet(f"{data_dir}/{name}.parquet")
