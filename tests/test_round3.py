"""Sketch queries beside their first SQL; micro-batches whose cost follows what they hold."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from minutemill.operators.dedupe import dedupe_stored
from minutemill.plans import registry
from minutemill.plans.oracle import ORACLE
from minutemill.session import STREAM_TASKS, TASKS_PER_CORE, stream_partitions
from minutemill.sources.event_log import EventLog, read_event_log, write_event_log
from minutemill.sources.tables import EventTables
from minutemill.streaming import ingest
from tests.conftest import rows_of
from tools.compare import connect, difference

ONCE = {"availableNow": True}
PARTITIONS = "spark.sql.shuffle.partitions"


@pytest.fixture
def many_users(tmp_path):
    """A data folder with 3,000 users on one day: more than a sketch lists."""
    duckdb.sql(
        f"""COPY (SELECT id AS event_id, TIMESTAMP '2024-01-10 10:00:00' + to_seconds(id % 3600) AS ts, id % 3000 AS user_id,
              'click' AS event_type, 1.5::DOUBLE AS value, '{{}}' AS props FROM range(4000) r(id))
            TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    return str(tmp_path)


@pytest.mark.parametrize("name", ["merge_sketches", "uniques_range"])
def test_users_of_merged_sketches_equal_sql_beyond_what_a_sketch_lists(spark, many_users, name):
    duck = connect(many_users) if name not in ("", None) else None
    got = registry.QUERIES[name](spark, many_users).toPandas()
    assert "count" in got.columns and len(got)
    assert difference(got, connect(many_users).execute(ORACLE[name]).df()) is None


def test_a_wrong_estimate_shows(spark):
    rows = [("a", str(i)) for i in range(1_200)] + [("b", str(i)) for i in range(10)]
    events = spark.createDataFrame(rows, "name string, distinct_id string")
    estimates = spark.createDataFrame([("a", 1_190), ("b", 9), ("c", 5)], "name string, count long")
    assert rows_of(registry._checked(estimates, events, ["name"])) == [("a", 1_200), ("b", 9), ("c", 5)]
    far = spark.createDataFrame([("a", 1_000)], "name string, count long")
    assert rows_of(registry._checked(far, events, ["name"])) == [("a", 1_000), ("b", None)]


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "200")
    yield
    spark.conf.set(PARTITIONS, before)


@pytest.mark.parametrize("kind", ["bounded", "state", "live"])
def test_state_follows_the_cores_and_not_the_partitions_of_whole_tables(spark, tmp_path, events_of, many_partitions, kind):
    log = EventLog("json", f"{tmp_path}/log", max_files_per_batch=1)
    for _ in range(2):
        rows = [(f"e{i}", "a", f"u{i % 3}", "2024-01-02 01:00:00") for i in range(8)]
        write_event_log(events_of(*rows).coalesce(1), log)
    records, tables = read_event_log(spark, log), EventTables(spark, f"{tmp_path}/tables").create()
    if kind == "bounded":
        query = ingest.ingest_stream_bounded(records, tables, f"{tmp_path}/cp", "1 second", trigger=ONCE)
    elif kind == "state":
        query = ingest.ingest_stream_with_state(records, tables, f"{tmp_path}/cp", trigger=ONCE)
    else:
        events = registry._event_stream(spark, log)
        query = ingest.live_rollup(events, f"{tmp_path}/tables", f"{tmp_path}/cp", ONCE)
    assert spark.conf.get(PARTITIONS) == "200"
    query.awaitTermination()
    state = query.recentProgress[0].stateOperators[0]
    assert state.numShufflePartitions <= max(STREAM_TASKS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == 8


def test_fewer_partitions_than_that_stay(spark):
    before = spark.conf.get(PARTITIONS)
    with stream_partitions(spark):
        assert spark.conf.get(PARTITIONS) == before
    assert spark.conf.get(PARTITIONS) == before


def test_a_micro_batch_is_used_once_and_history_is_not_sorted(spark):
    ts = datetime(2024, 1, 2)
    rows = [(i, "a", "u", "{}", ts + timedelta(seconds=n)) for n, i in enumerate(["1", "2", "2", "3", None, None])]
    batch = spark.createDataFrame(rows, "event_id string, name string, distinct_id string, properties string, ts timestamp")
    seen = spark.createDataFrame([("2",), ("2",), ("9",), (None,)], "event_id string")
    micro = dedupe_stored(batch, seen, micro=True)
    assert rows_of(micro) == rows_of(dedupe_stored(batch, seen))
    plan = micro._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "strategy=shuffle_hash" in plan


def test_cleaning_lets_go_of_what_packing_remembered(spark):
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import types as T

    from minutemill.llm import chunks, quality

    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array(["a few words of plain text"])})
    schema = T.StructType.fromDDL("doc_id long, text string")
    docs = SimpleNamespace(schema=schema, columns=["doc_id", "text"], mapInArrow=lambda run, _: list(run([batch])))
    chunks.shared(("test",), lambda: chunks.PartEncoder(lambda parts: [p.encode() for p in parts]))
    quality.clean_documents(docs)
    assert chunks._ENCODERS == {}
