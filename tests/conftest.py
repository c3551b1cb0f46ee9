"""One session for all tests, and a comparison of queries with their DuckDB counterparts."""

from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(value: object) -> object:
    """A value in a form that both engines share."""
    if value is None or pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if type(value).__name__ == "Timestamp":
        return str(value.date())
    try:
        return round(float(value), 6) if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows(frame) -> list[tuple]:  # noqa: ANN001
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con
