import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
