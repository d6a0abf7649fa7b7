import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from costlens.config import configure_session

    s = (
        SparkSession.builder.master("local[4]")
        .appName("costlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure_session(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cfg():
    from costlens.config import EngineConfig

    return EngineConfig(salt="test-salt")
