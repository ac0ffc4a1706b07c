import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import odd  # noqa: E402
import pytest  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return odd.documents(spark, [])
