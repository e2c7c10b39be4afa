import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanlake.session import configure

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


T0 = datetime(2024, 3, 1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def make_spans(spark):
    """Spans from (minute, service, duration_ns, status_code) rows."""

    def make(rows):
        data = [("default", f"{i:032x}", f"{i:016x}", "", "op", svc, "prod", at(m), int(d), int(st))
                for i, (m, svc, d, st) in enumerate(rows)]
        return spark.createDataFrame(
            data, "tenant_id string, trace_id string, span_id string, parent_span_id string, "
                  "name string, service string, env string, start_time timestamp, "
                  "duration_ns long, status_code int")

    return make
