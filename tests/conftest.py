import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', 4)}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", f"file://{base}/warehouse")
        .config("spark.checkpoint.dir", f"file://{base}/checkpoint")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    root = os.environ.get("TEST_DATA", "/root/testdata")
    if not os.path.isdir(f"{root}/sf0.001"):
        pytest.skip("no test tables here")
    return root
