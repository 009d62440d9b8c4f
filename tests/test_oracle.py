"""Every registered query against its SQL counterpart."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from minutemill.plans.oracle import ORACLE
from minutemill.plans.registry import QUERIES
from tests.conftest import SF_DIR
from tools.compare import connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["section", "name", "minute", "count"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, duck.execute(ORACLE[name]).df()) is None
    assert len(got) or name in ("minute_series", "filter_last_minutes")
