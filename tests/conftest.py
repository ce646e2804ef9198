from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # do not record a Python stack trace with every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def lines_of(spark, *texts, label="site"):
    rows = [(i, label, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq bigint, source_label string, raw_line string")


ENTRY = (
    "seq bigint, ts timestamp, source_ip string, method string, path string, status int, "
    "response_size bigint, user_agent string, referer string, raw_line string, "
    "source_label string, actor string, is_noise boolean"
)


def entries_of(spark, rows):
    """Entries from dicts; what a test does not care about gets a default."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    full = []
    for i, row in enumerate(rows):
        ip = row.get("ip", "10.0.0.1")
        ts = start + datetime.timedelta(seconds=row.get("at", i))
        full.append((
            row.get("seq", i), ts, ip, row.get("method", "GET"), row.get("path", "/"),
            row.get("status", 200), row.get("size", 100), row.get("agent", "Mozilla/5.0"), "-",
            row.get("line", f"{ip} - -"), row.get("source", "site"), ip, row.get("noise", False),
        ))
    return spark.createDataFrame(full, ENTRY)
