from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from runlens.session import tune  # noqa: E402


def make_session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="runlens-tests-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    builder = (
        SparkSession.builder.master("local[8]").appName("runlens-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", folder)
    )
    spark = tune(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
