import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "3")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    from oracle import duck as connect

    return connect(sf)


@pytest.fixture(scope="session")
def stub(spark):
    """Five items, two annotators, three classes, five features."""
    items = spark.createDataFrame([("0", 0), ("1", 1), ("2", 2), ("3", 0), ("4", 0)], "item_id string, gold_label int")
    features = spark.createDataFrame(
        [("0", 0, 1.0), ("0", 4, 2.0), ("1", 1, 3.0), ("1", 2, 1.0), ("2", 1, 1.0), ("2", 3, 4.0), ("3", 1, 1.0),
         ("3", 4, 1.0), ("4", 2, 4.0), ("4", 3, 1.0)], "item_id string, feature int, value double")
    annotations = spark.createDataFrame(
        [("0", 0, 0, 1), ("1", 1, 1, 1), ("2", 0, 2, 1), ("2", 1, 1, 1), ("3", 0, 0, 2), ("3", 1, 0, 1), ("3", 1, 1, 1)],
        "item_id string, annotator_id int, label int, n bigint")
    state = spark.createDataFrame(
        [("0", 0, 0), ("1", 1, 0), ("2", 2, 1), ("3", 1, 2), ("4", 0, 0)], "item_id string, y int, m int")
    return {"items": items, "features": features, "annotations": annotations, "state": state}
