import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="chronosift-test-"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows and a header to an event table of text columns."""
    from chronosift.plans.event_table import EventTable

    def build(header, rows, **options):
        names = [f"`{h}` string" for h in header]
        df = spark.createDataFrame(
            [(*r, i) for i, r in enumerate(rows)], ", ".join([*names, "rowno bigint"]))
        return EventTable.of(df, row_index="rowno", **options)

    return build
