from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.context import RunContext  # noqa: E402
from tidemark.sources.canonical import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ctx():
    """Reference 2026-04-04, cutoff 2026-01-04."""
    return RunContext(date(2026, 4, 4))


@pytest.fixture
def tables(spark):
    """tables(users=(rows, schema), ...) -> prepared inputs; the rest is empty."""

    def make(**raw):
        frames = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in raw.items()}
        return Tables(spark, frames)

    return make


def oid(n: int) -> str:
    return f"{n:024x}"


def one(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def by_key(df, key: str = "user_id") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
