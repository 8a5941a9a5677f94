import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Alignment rows from (name, group, sequence) tuples."""
    def build(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                     "sample_idx bigint, sample string, grp string, sequence string")
    return build
