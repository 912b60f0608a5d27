import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from recollect.session import build_session
    s = build_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column function on one literal row."""
    from pyspark.sql import functions as F

    def run(fn, *args):
        row = spark.range(1).select(*[F.lit(a).alias(f"c{i}") for i, a in enumerate(args)])
        return row.select(fn(*[f"c{i}" for i in range(len(args))]).alias("v")).first()["v"]
    return run


@pytest.fixture
def values(spark):
    """Evaluate a one-argument column function on many strings at once."""
    def run(fn, inputs):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
        return [r["v"] for r in df.select("i", fn("x").alias("v")).orderBy("i").collect()]
    return run
