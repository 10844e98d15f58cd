from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from filingflow.session import configure

    s = (
        SparkSession.builder.master("local[*]")
        .appName("filingflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # tests run without a cluster: the shared checkpoint folder is a local temp dir
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ff-test-ckpt-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (test helper only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
