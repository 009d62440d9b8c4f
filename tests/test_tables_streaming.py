import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from minutemill.operators.portable import (
    export_portable_sketches,
    portable_registers,
    portable_uniques_range,
    portable_uniques_today,
)
from minutemill.operators.reconcile import reconcile
from minutemill.operators.rollup import minute_rollup
from minutemill.operators.uniques import uniques_range
from minutemill.plans import inputs
from minutemill.schema import EVENT_COLUMNS
from minutemill.session import scratch_path
from minutemill.sources.event_log import (
    EventLog,
    decode_records,
    encode_records,
    read_event_log,
    write_event_log,
    write_event_log_stream,
)
from minutemill.sources.tables import EventTables
from minutemill.streaming import ingest, live
from tests.conftest import SF_DIR, rows_of

ONCE = {"availableNow": True}
MONTH = (date(2024, 1, 1), date(2024, 2, 28))


@pytest.fixture
def root(spark):
    return scratch_path(spark, "test")


@pytest.fixture
def tables(spark, root):
    return EventTables(spark, f"{root}/tables").create()


def snapshot(tables):
    return (
        rows_of(tables.events(), *EVENT_COLUMNS),
        rows_of(tables.minute_deltas().groupBy("name", "minute").agg(F.sum("n").alias("n"))),
        rows_of(uniques_range(tables.sketch_deltas(), *MONTH)),
    )


def test_a_repeated_batch_replaces_its_first_attempt(events_of, tables):
    batch = events_of(("1", "a", "u1", "2024-01-02 01:00:00"), ("2", "a", "u2", "2024-01-03 01:00:00"))
    ingest.ingest_batch(tables, batch, "b-0")
    before = snapshot(tables)
    ingest.ingest_batch(tables, batch, "b-0")
    assert snapshot(tables) == before
    ingest.ingest_batch(tables, batch, "b-1")  # a replay under another number adds nothing
    assert snapshot(tables) == before
    assert rows_of(tables.batch_health(), "batch_id", "batch_size", "inserted", "duplicates") == [
        ("b-0", 2, 2, 0),
        ("b-1", 2, 0, 2),
    ]


def test_a_smaller_second_attempt_leaves_nothing_behind(events_of, tables):
    one = ("1", "a", "u1", "2024-01-02 01:00:00")
    ingest.ingest_batch(tables, events_of(one, ("2", "a", "u2", "2024-01-03 01:00:00")), "b-0")
    ingest.ingest_batch(tables, events_of(one), "b-0")
    assert tables.events().count() == 1 and tables.minute_deltas().count() == 1


def test_an_unfinished_batch_is_invisible(events_of, tables, monkeypatch):
    batch = events_of(("1", "a", "u1", "2024-01-02 01:00:00"))

    def crash(*_):
        raise RuntimeError("stopped between two tables")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_sketch_deltas", crash)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(tables, batch, "b-0")
    assert snapshot(tables) == ([], [], [])
    ingest.ingest_batch(tables, batch, "b-0")
    assert len(snapshot(tables)[0]) == 1


def test_uniques_over_received_or_inserted(events_of, spark, root):
    batch = events_of(("1", "a", "u1", "2024-01-02 01:00:00"), ("1", "a", "u2", "2024-01-02 01:00:01"))
    for mode, expected in (("received", 2), ("inserted", 1)):
        tables = EventTables(spark, f"{root}/{mode}").create()
        ingest.ingest_batch(tables, batch, "b-0", uniques_over=mode)
        assert rows_of(uniques_range(tables.sketch_deltas(), *MONTH)) == [("a", expected)]
        assert tables.events().count() == 1
    with pytest.raises(ValueError):
        ingest.ingest_batch(tables, batch, "b-1", uniques_over="both")


def test_bounded_history_only_remembers_recent_days(events_of, tables):
    from tests.conftest import at

    old = events_of(("1", "a", "u1", "2024-01-02 01:00:00"))
    ingest.ingest_batch(tables, old, "b-0")
    recent = ingest.recent_days(3, at("2024-01-20 00:00:00"))
    ingest.ingest_batch(tables, old, "b-1", history=recent)
    assert tables.events().count() == 2


def test_compaction_keeps_every_answer(events_of, tables):
    for number in range(3):
        rows = [(f"{number}-{i}", "a", f"u{i}", "2024-01-02 01:00:00") for i in range(4)]
        rows.append((f"{number}-x", "a", "u9", "2024-01-03 01:00:00"))
        ingest.ingest_batch(tables, events_of(*rows), f"b-{number}")
    before, stored = snapshot(tables), tables.minute_deltas().count()
    assert tables.compact_deltas(date(2024, 1, 2))
    assert snapshot(tables) == before
    assert tables.minute_deltas().count() == stored - 2
    late = events_of(("late", "a", "u77", "2024-01-02 01:00:00"))
    ingest.ingest_batch(tables, late, "b-3")  # an old minute keeps growing
    before = snapshot(tables)
    tables.compact_deltas(date(2024, 1, 2))
    tables.compact_deltas(date(2024, 1, 2))
    assert snapshot(tables) == before
    assert tables.minute_deltas().filter("day = DATE '2024-01-02'").count() == 1
    assert tables.compact_deltas(date(1999, 1, 1)) is None


def deliveries(spark):
    return inputs.received(spark, SF_DIR).select(*EVENT_COLUMNS)


def test_stream_counts_each_event_once_across_restarts(spark, root, tables):
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    write_event_log(deliveries(spark).coalesce(1), log)
    spark.createDataFrame([("k", "not json", None), ("k", '{"name":"x"}', None)], "key string, value string, timestamp timestamp").coalesce(1).write.mode(
        "append"
    ).json(log.location)

    calls = []
    original = tables.commit

    def failing_once(*args, **kwargs):
        calls.append(args)
        if len(calls) == 1:
            raise RuntimeError("lost before the batch was marked done")
        return original(*args, **kwargs)

    tables.commit = failing_once

    def run():
        records = read_event_log(spark, log)
        ingest.ingest_stream(records, tables, f"{root}/checkpoint", trigger=ONCE).awaitTermination()

    with pytest.raises(Exception):
        run()
    run()
    write_event_log(deliveries(spark).coalesce(1), log)  # everything is delivered once more
    run()
    accepted = decode_records(read_event_log(spark, log, streaming=False)).filter("NOT malformed AND event_id <> ''")
    differences = reconcile(accepted, tables.events())
    assert differences.count() == 5 and differences.filter("difference <> 0").isEmpty()
    assert rows_of(tables.quarantine(), "reason") == [("event_id is required",), ("invalid JSON body",)]
    stored = tables.events().count()
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == stored == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert tables.batch_health().count() >= 3  # one file per micro-batch


def test_log_round_trip_keeps_time_and_skips_nothing(spark, root):
    log = EventLog("json", f"{root}/log")
    events = inputs.events(spark, SF_DIR)
    write_event_log(events, log)
    back = decode_records(read_event_log(spark, log, streaming=False))
    plain = events.withColumn("properties", F.regexp_replace("properties", " ", ""))
    assert rows_of(back, *EVENT_COLUMNS) == rows_of(plain, *EVENT_COLUMNS)


def test_arrival_time_fills_in_for_a_missing_time(spark):
    from tests.conftest import at

    rows = [("k", '{"event_id":"1","name":"a"}', at("2024-01-05 00:00:00")),
            ("k", '{"event_id":"2","name":"a","ts":"2024-01-01T00:00:00.5Z"}', at("2024-01-05 00:00:00"))]
    df = decode_records(spark.createDataFrame(rows, "key string, value string, timestamp timestamp"))
    assert rows_of(df, "event_id", "ts") == [("1", "2024-01-05 00:00:00"), ("2", "2024-01-01 00:00:00")]


def test_kafka_options_bound_a_batch_and_refuse_gaps():
    options = EventLog("kafka", "broker:9092", topic="clicks", max_records_per_batch=500).read_options()
    assert options["maxOffsetsPerTrigger"] == "500" and options["failOnDataLoss"] == "true"
    assert options["subscribe"] == "clicks" and options["kafka.bootstrap.servers"] == "broker:9092"
    assert "minOffsetsPerTrigger" not in options
    waiting = EventLog("kafka", "broker:9092", min_records_per_batch=1_000, max_delay="200ms").read_options()
    assert (waiting["minOffsetsPerTrigger"], waiting["maxTriggerDelay"]) == ("1000", "200ms")


def test_log_can_be_forwarded_as_a_stream(spark, root):
    source, copy = EventLog("json", f"{root}/log"), EventLog("json", f"{root}/copy")
    write_event_log(inputs.events(spark, SF_DIR), source)
    stream = decode_records(read_event_log(spark, source)).select(*EVENT_COLUMNS)
    write_event_log_stream(stream, copy, f"{root}/cp", ONCE).awaitTermination()
    both = [rows_of(decode_records(read_event_log(spark, log, streaming=False)), *EVENT_COLUMNS) for log in (source, copy)]
    assert both[0] == both[1] and len(both[0]) == 1_000


def test_records_are_keyed_by_name(spark, events_of):
    row = encode_records(events_of(("1", "buy", "u", "2024-01-02 01:00:00"))).first()
    assert row.key == "buy"
    assert row.value == (
        '{"event_id":"1","name":"buy","distinct_id":"u","properties":{},"ts":"2024-01-02T01:00:00.000000Z"}'
    )


def test_streaming_dedupe(spark, root):
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    for _ in range(2):
        write_event_log(deliveries(spark).coalesce(1), log)
    stream = decode_records(read_event_log(spark, log)).select(*EVENT_COLUMNS)
    for label, once in (("all", live.dedupe_stream(stream)), ("near", live.thin_recent_copies(stream, "60 days"))):
        live.append_stream(once, f"{root}/{label}", f"{root}/cp-{label}", ONCE).awaitTermination()
        ids = spark.read.parquet(f"{root}/{label}").select("event_id")
        assert ids.count() == ids.distinct().count() == 1_000


def test_live_counters_hold_few_ids_and_files(spark, root, monkeypatch):
    """Six deliveries of everything: state forgets, days are folded, the counts stay."""
    monkeypatch.setattr(ingest, "MOST_PARTS", 2)
    monkeypatch.setattr(ingest, "FOLD_EVERY", 3)
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    two_days = deliveries(spark).filter("ts < '2024-01-03'").coalesce(1)
    for part in range(3):
        write_event_log(two_days.filter(f"event_id % 3 = {part}"), log)
    for _ in range(3):
        write_event_log(two_days, log)
    stream = decode_records(read_event_log(spark, log)).select(*EVENT_COLUMNS)
    query = ingest.live_rollup(stream, f"{root}/live", f"{root}/cp", ONCE, horizon="1 second")
    query.awaitTermination()
    events = two_days.select("event_id").distinct().count()
    assert ingest.read_live_rollup(spark, f"{root}/live").agg(F.sum("n")).first()[0] == events
    tables = EventTables(spark, f"{root}/live")
    assert tables.batch_health().count() >= 6
    assert max(len(tables.snapshot().parts("minute_deltas", day, day)) for day in (date(2024, 1, 1), date(2024, 1, 2))) <= 2
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in state) > 0 and state[-1]["numRowsTotal"] < events * 4


def test_copies_behind_the_horizon_never_count(spark, root, tables):
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    copies = deliveries(spark).coalesce(1)
    for _ in range(3):
        write_event_log(copies, log)

    def run():
        records = read_event_log(spark, log)
        query = ingest.ingest_stream_bounded(records, tables, f"{root}/cp", "1 second", trigger=ONCE, portable=True)
        query.awaitTermination()
        return [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]

    state = run()
    assert sum(s["numRowsRemoved"] for s in state) > 0
    write_event_log(copies, log)
    run()  # after a restart
    assert rows_of(tables.events().agg(F.count("*"), F.count_distinct("event_id"))) == [(1_000, 1_000)]
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == 1_000


def test_batches_of_files_are_bounded_by_bytes(spark, root):
    plain = EventLog("json", f"{root}/log")
    for n in (400, 5, 5, 5, 5, 5):
        write_event_log(inputs.events(spark, SF_DIR).limit(n).coalesce(1), plain)
    sizes = sorted((os.path.getsize(f) for f in glob.glob(f"{plain.location}/*.json")))
    bound = sum(sizes[:3])
    log = EventLog("json", plain.location, max_bytes_per_batch=bound)
    stream = read_event_log(spark, log)
    query = live.append_stream(stream, f"{root}/out", f"{root}/cp", ONCE)
    query.awaitTermination()
    rows = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(rows) == 425 and 400 in rows and all(n <= 15 for n in rows if n < 400)


def test_hot_id_is_thinned_before_the_shuffle(events_of):
    rows = [("hot", "a", "u", "2024-01-02 01:00:00")] * 3_000 + [("x", "a", "u", "2024-01-02 01:00:00")]
    thinned = live.drop_nearby_copies(events_of(*rows).coalesce(1))
    assert thinned.count() < 10 and rows_of(thinned.select("event_id").distinct()) == [("hot",), ("x",)]


def test_state_ingest_counts_once_across_restarts(spark, root, tables):
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)

    def run():
        records = read_event_log(spark, log)
        ingest.ingest_stream_with_state(
            records, tables, f"{root}/checkpoint", trigger=ONCE, portable=True
        ).awaitTermination()

    write_event_log(deliveries(spark), log)
    run()
    write_event_log(deliveries(spark), log)
    run()
    assert rows_of(tables.events().agg(F.count("*"), F.count_distinct("event_id"))) == [(1_000, 1_000)]
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == 1_000
    bad = spark.createDataFrame([("k", "oops", None)] * 2, "key string, value string, timestamp timestamp")
    bad.write.mode("append").json(log.location)
    ingest.quarantine_stream(read_event_log(spark, log), f"{root}/bad", f"{root}/cp-bad", ONCE).awaitTermination()
    assert rows_of(spark.read.parquet(f"{root}/bad"), "reason") == [("invalid JSON body",)] * 2


def test_imported_history_merges_with_new_batches(spark, events_of, tables):
    old = events_of(*[(f"o{i}", "a", f"u{i}", "2024-01-02 01:00:00") for i in range(50)])
    sketches = export_portable_sketches(portable_registers(old))
    damaged = sketches.select(F.lit("b").alias("name"), "day", F.substring("sketch", 1, 9).alias("sketch"))
    rejected = ingest.import_history(
        tables, "import-0", events=old, counters=minute_rollup(old), sketches=sketches.unionAll(damaged)
    )
    assert rows_of(rejected, "name") == [("b",)]
    new = [(f"n{i}", "a", f"u{i}", "2024-01-02 02:00:00") for i in range(40, 60)]
    ingest.ingest_batch(tables, events_of(*new, ("o1", "a", "u1", "2024-01-02 02:00:00")), "b-0", portable=True)
    ranged = portable_uniques_range(tables.register_deltas(), date(2024, 1, 2), date(2024, 1, 2))
    assert rows_of(ranged) == [("a", 60)]
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == tables.events().count() == 70
    tables.compact_deltas(date(2024, 1, 2))
    ranged = portable_uniques_today(tables.register_deltas(), "2024-01-02 23:00:00")
    assert rows_of(ranged) == [("a", 60)]
