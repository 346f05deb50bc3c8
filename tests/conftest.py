import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "riskloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("supplied tables not present")
    return DATA


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on one text."""

    def run(make, *values):
        names = [f"c{i}" for i in range(len(values))]
        row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
        from pyspark.sql import functions as F

        return row.select(make(*[F.col(n) for n in names]).alias("out")).first()["out"]

    return run
