import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from minutemill.schema import EVENT  # noqa: E402
from minutemill.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.fixture
def events_of(spark):
    """Events from short tuples (event_id, name, distinct_id, time)."""

    def make(*rows):
        full = [(i, n, u, "{}", at(t)) for i, n, u, t in rows]
        return spark.createDataFrame(full, EVENT)

    return make


def rows_of(df, *columns):
    """Sorted plain tuples; timestamps as UTC text."""
    columns = columns or tuple(df.columns)
    shown = [
        F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c)
        for c in columns
    ]
    return sorted((tuple(r) for r in df.select(*shown).collect()), key=repr)
