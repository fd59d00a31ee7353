import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from titleloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """values(column, rows): the column evaluated over rows of one string column x."""

    def run(column, rows):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, x STRING")
        return [r[0] for r in df.orderBy("i").select(column).collect()]

    return run
