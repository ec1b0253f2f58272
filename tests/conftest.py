"""A small session, and a comparison with DuckDB."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip("the test tables aren't here")
    return TESTDATA


def plain(value):
    """A value as text that doesn't depend on who made it."""
    import numpy as np
    import pandas as pd

    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return None if value != value else f"{value:.9g}"
    if isinstance(value, (int, np.integer)):
        return f"{float(value):.9g}" if abs(int(value)) < 2**53 else str(int(value))
    return str(value)


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return db
