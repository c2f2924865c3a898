import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = (SparkSession.builder.master("local[*]").appName("driftline-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        # tests run in local mode: a local folder is the shared folder here
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-test-ckpt-"))
    yield spark
    spark.stop()


TOW_MIN = ("cruise_name STRING, station INT, zoo_gear STRING, ich_gear STRING, region INT, "
           "date STRING, month INT, year INT, cluhar_10m2 DOUBLE, scosco_10m2 DOUBLE, "
           "pepspp_10m2 DOUBLE, ammspp_10m2 DOUBLE, volume_1m2 DOUBLE, _row BIGINT")


@pytest.fixture
def tows(spark):
    """Build a ``tow_min`` frame from dicts (missing keys are NULL); ``_row`` = file order."""
    names = [f.split()[0] for f in TOW_MIN.split(", ")]

    def make(rows):
        data = []
        for i, r in enumerate(rows):
            r = {"_row": i, **r}
            data.append(tuple(r.get(n) for n in names))
        return spark.createDataFrame(data, TOW_MIN)
    return make
