import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TESTDATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from weftlink.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column builder over single texts: ``one(fn, value) -> value``."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        out = [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]
        return out[0] if len(values) == 1 else out

    return run
