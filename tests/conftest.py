import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from docweave.runtime import get_session
    return get_session("tests", cpus=8)


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture
def one(spark):
    """Value of one column expression over one string."""
    from pyspark.sql import functions as F

    def run(text, expression):
        frame = spark.createDataFrame([(text,)], "text string")
        return frame.select(expression(F.col("text")).alias("v")).first()["v"]
    return run
