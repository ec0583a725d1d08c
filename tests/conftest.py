import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowguard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "flowguard-tests")


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over a list of strings, in order."""

    def run(values, expression):
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, "n int, s string")
        return [r.v for r in df.select("n", expression.alias("v")).orderBy("n").collect()]

    return run
