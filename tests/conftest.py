import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerlink-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from ledgerlink.scratch import release

    release(session)
    session.stop()


@pytest.fixture
def table(spark):
    """Text table with a row id, from a list of tuples."""

    def make(columns, rows):
        ddl = "row_id long, " + ", ".join(f"{c} string" for c in columns)
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ddl)

    return make
