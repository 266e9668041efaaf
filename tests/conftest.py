import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from episcope.session import get_session
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    get_session()  # fills in unset defaults (checkpoint folder) only
    yield s


@pytest.fixture
def curated_fixture(spark):
    """A 12-row case table: one case a day from 2024-12-01."""
    base = dt.date(2024, 12, 1)
    rows = [(base + dt.timedelta(days=i), "SP", int(i % 4 == 0), int(i % 3 == 0), int(i % 2 == 0))
            for i in range(12)]
    return spark.createDataFrame(rows, "dt_notific DATE, sg_uf STRING, obito INT, internou_uti INT, vacinado INT")
