"""Nothing lost, nothing counted twice: restarts, late events, large records, null clients, renamed copies."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from minutemill.operators.health import rejected_rate_by_reason
from minutemill.operators.quota import fixed_window_quota, token_bucket_quota
from minutemill.operators.reconcile import reconcile
from minutemill.operators.validate import reject_counts
from minutemill.schema import EVENT_COLUMNS
from minutemill.sources.event_log import EventLog, decode_records, read_event_log, write_event_log
from minutemill.sources.json_lines import parse_event_json
from minutemill.sources.tables import EventTables
from minutemill.streaming import ingest, live
from tests.conftest import at, rows_of

ONCE = {"availableNow": True}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("second", [ingest.ingest_stream, ingest.ingest_stream_with_state])
def test_new_checkpoint_over_filled_tables(spark, root, events_of, second):
    tables = EventTables(spark, f"{root}/tables").create()
    first_log, second_log = EventLog("json", f"{root}/log1"), EventLog("json", f"{root}/log2")
    write_event_log(events_of(*[(f"e{i}", "a", "u", "2024-01-02 01:00:00") for i in range(10)]), first_log)
    write_event_log(events_of(*[(f"e{i}", "a", "u", "2024-01-02 01:00:00") for i in range(8, 13)]), second_log)
    ingest.ingest_stream(read_event_log(spark, first_log), tables, f"{root}/cp1", trigger=ONCE).awaitTermination()
    second(read_event_log(spark, second_log), tables, f"{root}/cp2", trigger=ONCE).awaitTermination()
    assert tables.events().count() == 13
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == 13


def test_bounded_dedupe_keeps_late_events(spark, root, events_of):
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    for row in (("a", "01:00:00"), ("b", "09:00:00"), ("late", "02:00:00"), ("b", "09:00:00"), ("c", "09:10:00")):
        write_event_log(events_of((row[0], "n", "u", f"2024-01-02 {row[1]}")).coalesce(1), log)
    stream = decode_records(read_event_log(spark, log)).select(*EVENT_COLUMNS)
    once = live.thin_recent_copies(stream, "1 hour")
    live.append_stream(once, f"{root}/out", f"{root}/cp", ONCE).awaitTermination()
    assert rows_of(spark.read.parquet(f"{root}/out"), "event_id") == [("a",), ("b",), ("c",), ("late",)]


def test_log_records_have_no_size_limit_and_requests_no_time(spark):
    body = '{"event_id":"1","name":"a","properties":{"x":"' + "y" * (1 << 20) + '"},"ts":"2024-01-02T00:00:00Z"}'
    rows = spark.createDataFrame([("k", body, at("2024-01-05 00:00:00"))], "key string, value string, timestamp timestamp")
    assert rows_of(decode_records(rows), "malformed", "ts") == [(False, "2024-01-02 00:00:00")]
    small = ['{"event_id":"1","name":"a","ts":%s}' % ts for ts in ('"garbage"', "5", '"1999-01-01T00:00:00Z"')]
    requests = parse_event_json(spark.createDataFrame([(v,) for v in [*small, body]], "value string"))
    assert rows_of(requests, "malformed", "ts") == [(False, None)] * 3 + [(True, None)]


def test_null_clients_share_a_limited_bucket(spark):
    rows = [(i, None if i % 2 else "unknown", at("2024-01-02 00:00:00")) for i in range(6)]
    requests = spark.createDataFrame(rows, "request_id long, client string, ts timestamp")
    for judged in (fixed_window_quota(requests, 1), token_bucket_quota(requests, 1, burst=1)):
        assert rows_of(judged.filter("allowed"), "request_id") == [(0,)]


def test_reconcile_counts_an_id_under_its_stored_name(spark, events_of):
    accepted = events_of(("e1", "a", "u", "2024-01-02 01:00:00"), ("e1", "b", "u", "2024-01-02 02:00:00"),
                         ("e2", "b", "u", "2024-01-02 03:00:00"), ("e2", "a", "u", "2024-01-02 04:00:00"))
    stored = events_of(("e1", "a", "u", "2024-01-02 01:00:00"))
    assert rows_of(reconcile(accepted, stored)) == [("a", 1, 1, 0), ("b", 1, 0, 1)]


def test_reasons_keep_their_class(spark):
    reasons = ["name is required", "invalid JSON body", "rate_limited", "queue_full", "shutdown", "not_ingest", None]
    rows = spark.createDataFrame([(at("2024-01-02 00:00:00"), r) for r in reasons], "ts timestamp, reason string")
    want = [("invalid", 2), ("not_ingest", 1), ("queue_full", 1), ("rate_limited", 1), ("shutdown", 1)]
    assert rows_of(reject_counts(rows)) == want
    rates = rejected_rate_by_reason(rows.filter("reason IS NOT NULL"))
    assert sorted((r.reason, round(r.per_second * 60)) for r in rates.collect()) == want


def test_a_committed_batch_is_replaced_whole_or_not_at_all(spark, root, events_of):
    tables = EventTables(spark, f"{root}/replaced").create()
    batch = events_of(("1", "a", "u1", "2024-01-02 01:00:00"))
    assert not tables.is_committed("b-0")
    ingest.ingest_batch(tables, batch, "b-0")
    assert tables.is_committed("b-0") and not tables.is_committed("b-1")
    tables.withdraw("b-0")
    assert tables.events().count() == 0
    ingest.ingest_batch(tables, batch, "b-0")
    tables.compact_deltas(date(2024, 1, 2))
    with pytest.raises(ValueError, match="compacted"):
        ingest.ingest_batch(tables, batch, "b-0")
