import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from enrichspark.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows(spark):
    """Make a DataFrame from rows and a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture()
def one(spark):
    """Value of a Column over one text."""
    from pyspark.sql import functions as F

    def value(build, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string")
        got = [r[0] for r in df.select(build(F.col("x"))).collect()]
        return got[0] if len(texts) == 1 else got

    return value
