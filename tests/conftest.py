import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

from fleetweave.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def one(spark):
    """`one(f, *values)`: the results of a Column function for values of one text column."""

    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        from pyspark.sql import functions as F

        return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]

    return run
