import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def messages(spark):
    """Build a message table from texts."""

    def build(*texts):
        rows = [(str(i), t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "msg_id string, message string")

    return build


@pytest.fixture()
def one(messages):
    """Apply a table function to one text and return its row."""

    def run(fn, text):
        return fn(messages(text)).first()

    return run
