import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def make_entries(spark):
    """Entries from (seq, seconds, level, service, message) rows."""
    def make(rows):
        df = spark.createDataFrame(
            [(f"id{r[0]:06d}", r[0], float(r[1]), *r[2:]) for r in rows],
            "id string, seq long, secs double, level string, service string, message string",
        )
        return df.selectExpr(
            "id", "seq", "timestamp_micros(cast(round((1704067200 + secs) * 1000000) as bigint))::timestamp_ntz as timestamp",
            "level", "service", "'src' as source_id", "message", "message as raw", "cast(null as array<string>) as stacktrace",
        )
    return make
