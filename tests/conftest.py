import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from occupipe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Evaluate a column function on Python values."""
    def run(function, *values):
        names = [f"v{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} string" for n in names)
        from pyspark.sql import functions as F

        row = spark.createDataFrame([tuple(values)], schema).select(function(*[F.col(n) for n in names]).alias("r"))
        return row.first()["r"]

    return run
