"""One local Spark session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
#: The driver's tables; tests that need them are skipped elsewhere.
DATA = os.environ.get("QUILLON_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quillon.session import prepare

    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{made}/shared").config("spark.sql.warehouse.dir", f"{made}/warehouse").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    found = f"{DATA}/sf0.001"
    if not os.path.isdir(found):
        pytest.skip("no test tables")
    return found


@pytest.fixture(scope="session")
def medium() -> str:
    found = f"{DATA}/sf0.01"
    if not os.path.isdir(found):
        pytest.skip("no test tables")
    return found
