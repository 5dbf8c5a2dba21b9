import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def col(spark):
    """Values of a column function over single-column rows."""

    def run(values, kind, f):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
        return [r[0] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").select("x").collect()]

    return run
