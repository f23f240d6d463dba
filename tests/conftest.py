import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fiscalis.session import local_session

    session = local_session("tests", 4, shuffle_partitions=4, memory="4g", scratch=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column function on a list of values."""
    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        from pyspark.sql import functions as F
        return [r[0] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").select("x").collect()]
    return run
