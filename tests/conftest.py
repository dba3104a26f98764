"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    home = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(home / "shared"), "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.local.dir": str(home / "local"), "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    if not os.path.isdir(SF):
        pytest.skip(f"no tables in {SF}")
    return SF


@pytest.fixture(scope="session")
def same_rows(spark, sf):
    """Asserts that a query and its SQL give the same rows, in any order."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def check(query, sql: str) -> None:
        got = query(spark, sf).toPandas()
        want = con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert len(got) == len(want)
        # both through the same doors, so that types that hold the same values are equal
        text = lambda frame: sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)).values.tolist()))
        assert text(got) == text(want)

    return check
