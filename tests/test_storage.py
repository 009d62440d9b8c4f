"""The stored tables after many batches: snapshots, compaction, the id index, the tree of sketches, removal."""

import glob
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from minutemill.functions.timing import known_at
from minutemill.operators import sketch_tree
from minutemill.operators.reconcile import differing_buckets, fingerprint, reconcile, reconcile_tables
from minutemill.operators.rollup import count_today, filter_today
from minutemill.operators.uniques import estimate, merge_sketches, uniques_range
from minutemill.plans import dashboard, inputs
from minutemill.schema import EVENT_COLUMNS
from minutemill.session import scratch_path
from minutemill.sources import id_index, manifest
from minutemill.sources.manifest import Part
from minutemill.sources.tables import EventTables
from minutemill.streaming import ingest
from tests.conftest import SF_DIR, rows_of

DAY = date(2024, 1, 2)
NOW = timedelta(0)


@pytest.fixture
def tables(spark):
    return EventTables(spark, scratch_path(spark, "store")).create()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch_of(events_of, *ids, day="2024-01-02", name="a"):
    return events_of(*[(str(i), name, f"u{i}", f"{day} 01:00:00") for i in ids])


def test_a_day_is_read_alone_after_many_batches(spark, events_of, tables):
    """20,000 batches on record, over ten years: reading a day lists its own folders and joins nothing."""
    ingest.ingest_batch(tables, batch_of(events_of, 1, 2, 3), "real")
    others = [
        Part("minute_deltas", f"day={day}", f"p-{i}", day=day, batch_id=f"b-{i}")
        for i in range(20_000)
        if (day := date(2014, 1, 1) + timedelta(days=i % 3_600)) != DAY
    ]
    tables.manifest.checkpoint(others)
    snapshot = tables.snapshot()
    assert len(snapshot.parts("minute_deltas", DAY, DAY)) == 1
    rows = snapshot.minute_deltas(DAY, DAY)
    assert len(rows.inputFiles()) == 1 and "/day=2024-01-02/" in rows.inputFiles()[0]
    plan = plan_of(rows)
    assert "Exchange" not in plan and "Join" not in plan and "PartitionFilters: [isnotnull(day" in plan
    assert rows.agg(F.sum("n")).first()[0] == 3
    assert len(snapshot.parts("minute_deltas")) == len(others) + 1


def test_a_snapshot_stays_as_it_was(events_of, tables):
    ingest.ingest_batch(tables, batch_of(events_of, 1, 2), "b-0")
    before = tables.snapshot()
    ingest.ingest_batch(tables, batch_of(events_of, 2, 3, 4), "b-1")
    tables.compact_deltas(DAY)
    tables.compact_events(DAY)
    ingest.ingest_batch(tables, batch_of(events_of, 5), "b-2")
    again = tables.snapshot(before.generation)
    for old in (before, again):
        assert old.events().count() == 2 and old.minute_deltas().agg(F.sum("n")).first()[0] == 2
        assert rows_of(uniques_range(old.sketch_deltas(), DAY, DAY)) == [("a", 2)]
    now = tables.snapshot()
    assert now.events().count() == 5 and now.minute_deltas().agg(F.sum("n")).first()[0] == 5
    with pytest.raises(ValueError, match="not in"):
        tables.snapshot(now.generation + 1)


def test_checkpoints_keep_everything(events_of, tables, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT_EVERY", 2)
    for i in range(5):
        ingest.ingest_batch(tables, batch_of(events_of, i, i + 1), f"b-{i}")
    assert len(glob.glob(f"{tables.root}/manifest/base=*")) == 3
    assert tables.events().count() == 6
    health = rows_of(tables.batch_health(), "batch_id", "batch_size", "inserted", "duplicates")
    assert health == [("b-0", 2, 2, 0)] + [(f"b-{i}", 2, 1, 1) for i in range(1, 5)]
    assert tables.is_committed("b-0") and tables.is_committed("b-4") and not tables.is_committed("b-5")
    ingest.ingest_batch(tables, batch_of(events_of, 0, 1, 99), "b-0")  # replaced, though long ago
    assert tables.events().count() == 7 and ("b-0", 3) in rows_of(tables.batch_health(), "batch_id", "batch_size")


def test_a_checkpoint_cut_off_is_passed_over(spark, events_of, tables):
    ingest.ingest_batch(tables, batch_of(events_of, 1), "b-0")
    newest = tables.snapshot().generation
    spark.createDataFrame([], "table string").write.parquet(f"{tables.root}/manifest/base={newest + 1}/generation={newest + 1}")
    assert tables.events().count() == 1 and tables.snapshot().generation == newest


def test_files_of_old_parts_go_after_the_grace_period(events_of, tables, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT_EVERY", 3)
    for i in range(2):
        ingest.ingest_batch(tables, batch_of(events_of, i), f"b-{i}")

    def crash(*_):
        raise RuntimeError("stopped between two tables")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(tables, "write_sketch_deltas", crash)
        ingest.ingest_batch(tables, batch_of(events_of, 9), "b-3")
    tables.compact_deltas(DAY)
    tables.compact_events(DAY)
    tables.compact_ids()
    before = rows_of(tables.events(), *EVENT_COLUMNS), rows_of(tables.minute_deltas()), tables.batch_health().count()

    def folders():
        return set(glob.glob(f"{tables.root}/*/*/part=*"))

    there = folders()
    assert tables.remove_dead(timedelta(days=1)) == 0 and folders() == there
    assert tables.remove_dead(NOW) == len(there) - len(folders()) > 6
    live = {f"{tables.root}/{p.path}" for t in ("events", "minute_deltas", "sketch_deltas", "event_ids", "batch_health")
            for p in tables.snapshot().parts(t)}
    assert folders() == live
    after = rows_of(tables.events(), *EVENT_COLUMNS), rows_of(tables.minute_deltas()), tables.batch_health().count()
    assert after == before and tables.remove_dead(NOW) == 0
    assert len(glob.glob(f"{tables.root}/manifest/base=*")) == 1
    ingest.ingest_batch(tables, batch_of(events_of, 0, 9), "b-4")  # ids are still known
    assert tables.events().count() == 3


def test_two_compactions_at_once_do_not_count_twice(events_of, tables, monkeypatch):
    for i in range(2):
        ingest.ingest_batch(tables, batch_of(events_of, i), f"b-{i}")
    write, calls = tables._write, []

    def overtaken(table, *args, **kwargs):
        if not calls:
            calls.append(table)
            EventTables(tables.spark, tables.root).compact_deltas(DAY)
        return write(table, *args, **kwargs)

    monkeypatch.setattr(tables, "_write", overtaken)
    with pytest.raises(ValueError, match="replaced by another commit"):
        tables.compact_deltas(DAY)
    assert tables.minute_deltas().agg(F.sum("n")).first()[0] == 2


def test_failed_attempts_are_on_record(events_of, tables, monkeypatch):
    def crash(*_):
        raise RuntimeError("no room left")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(tables, "write_minute_deltas", crash)
        ingest.ingest_batch(tables, batch_of(events_of, 1, 2), "b-0")
    health = rows_of(tables.batch_health(), "batch_id", "batch_size", "inserted", "error")
    assert health == [("b-0", 2, 0, "RuntimeError: no room left")]
    assert not tables.is_committed("b-0") and tables.events().isEmpty()
    ingest.ingest_batch(tables, batch_of(events_of, 1, 2), "b-0")
    assert rows_of(tables.batch_health(), "batch_id", "inserted") == [("b-0", 0), ("b-0", 2)]


def test_import_history_leaves_known_ids_out_and_can_be_repeated(events_of, tables):
    ingest.ingest_batch(tables, batch_of(events_of, 1, 2), "b-0")
    for _ in range(2):
        ingest.import_history(tables, "old", events=batch_of(events_of, 2, 3, 4))
    assert rows_of(tables.events(), "event_id") == [("1",), ("2",), ("3",), ("4",)]
    ingest.ingest_batch(tables, batch_of(events_of, 4, 5), "b-1")
    assert tables.events().count() == 5


# -- reconciliation by fingerprints -------------------------------------------------------------


def test_nothing_lost_is_seen_without_a_shuffle_of_ids(events_of, tables):
    copies = [batch_of(events_of, *range(60)), batch_of(events_of, *range(40, 90), name="b")]
    for i, rows in enumerate(copies):
        ingest.ingest_batch(tables, rows, f"b-{i}")
    accepted = copies[0].unionAll(copies[1])
    found = reconcile_tables(accepted, tables)
    plan = plan_of(found)
    assert "event_id" not in plan.replace("xxhash64(event_id", "") and plan.count("Exchange hashpartitioning(name") == 1
    assert rows_of(found) == [("a", 60, 60, 0), ("b", 30, 30, 0)]
    assert rows_of(found) == rows_of(reconcile(accepted, tables.events()))


def test_planted_losses_are_found_by_name(events_of, tables):
    ingest.ingest_batch(tables, batch_of(events_of, *range(50)), "b-0")
    ingest.ingest_batch(tables, batch_of(events_of, *range(50, 80), name="b"), "b-1")
    everything = batch_of(events_of, *range(50)).unionAll(batch_of(events_of, *range(50, 83), name="b"))
    # Three accepted events never reached a batch.
    assert rows_of(reconcile_tables(everything, tables)) == [("a", 50, 50, 0), ("b", 33, 30, 3)]
    # A file of stored events is lost after it was committed.
    lost = tables._parts_of("b-0", "events")
    tables.manifest.commit([], lost)
    assert rows_of(reconcile_tables(everything, tables)) == [("a", 50, 0, 50), ("b", 33, 30, 3)]
    # An event that nobody has accepted.
    ingest.ingest_batch(tables, batch_of(events_of, 500, name="c"), "b-2")
    assert ("c", 0, 1, -1) in rows_of(reconcile_tables(everything, tables))


def test_fingerprints_add_up(spark, events_of):
    whole = batch_of(events_of, *range(100), *range(20))
    total = whole.agg(fingerprint().alias("p")).first().p
    parts = [whole.filter(f"cast(event_id as int) % 3 = {k}").agg(fingerprint().alias("p")).first().p for k in range(3)]
    assert [sum(n) for n in zip(*parts)] == total and sum(total[:: 4]) == 120
    one_less = whole.filter("event_id <> '7'").agg(fingerprint().alias("p")).first().p
    assert len(differing_buckets(total, one_less)) == 1 and differing_buckets(total, total) == []
    assert whole.limit(0).agg(fingerprint().alias("p")).first().p == [0] * 64


# -- the id index -------------------------------------------------------------------------------


def scanned_rows(df):
    """Rows that the file scans of a plan have handed on, after it has run."""
    df.collect()
    node, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = node.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if "FileSource" in leaves.apply(i).getClass().getSimpleName():
            total += metrics.apply("numOutputRows").value()
    return total


@pytest.fixture(scope="module")
def indexed(spark):
    """300,000 known ids, folded into their buckets by ranges."""
    tables = EventTables(spark, scratch_path(spark, "index")).create()
    history = spark.range(300_000).select(F.col("id").cast("string").alias("event_id"))
    tables.write_event_ids(history, "old")
    tables.commit("old", 300_000, 300_000, 0.0, None)
    assert tables.compact_ids() == 1
    return tables


def test_small_batch_reads_few_buckets_and_pages(spark, indexed):
    batch = spark.createDataFrame([("17",), ("299999",), ("new",), ("newer",)], "event_id string")
    found = indexed.known_ids(batch)
    assert rows_of(found) == [("17",), ("299999",)]
    folders = {f.split("/bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert 1 <= len(folders) <= 4
    assert "In(id_hash" in plan_of(found) or "EqualTo(id_hash" in plan_of(found)
    whole = indexed.read_parts("event_ids", indexed.snapshot().parts("event_ids"))
    assert scanned_rows(found) < 300_000 / 20 and whole.count() == 300_000


def test_every_known_id_is_found_at_any_batch_size(spark, indexed, monkeypatch):
    for n, step in ((5, 60_000), (350, 1_000), (3_000, 100)):
        batch = spark.range(n).select((F.col("id") * step + 150_000).cast("string").alias("event_id"))
        known = {str(i * step + 150_000) for i in range(n)} & {str(i) for i in range(300_000)}
        found = indexed.known_ids(batch).join(batch, "event_id", "left_semi")
        assert {r.event_id for r in found.collect()} == known
    assert 3_000 > id_index.PUSHED_IDS
    assert indexed.known_ids(spark.createDataFrame([], "event_id string")).isEmpty()


def test_recent_and_folded_ids_are_both_known(spark, events_of, tables, monkeypatch):
    monkeypatch.setattr(id_index, "MOST_PARTS", 2)
    for i in range(4):
        ingest.ingest_batch(tables, batch_of(events_of, 10 * i, 10 * i + 1), f"b-{i}")
        if i % 2:
            assert tables.compact_ids() >= 2
    assert tables.compact_ids() == 0
    ingest.ingest_batch(tables, batch_of(events_of, 0, 1, 10, 11, 20, 21, 30, 31, 99), "b-4")
    assert tables.events().count() == 9
    with pytest.raises(ValueError, match="compacted"):
        ingest.ingest_batch(tables, batch_of(events_of, 0), "b-0")


def test_a_second_writer_is_seen_by_a_running_state_stream(spark, events_of, tables):
    prefix = "log-x-"
    assert not tables.other_writers(prefix)
    ingest.ingest_batch(tables, batch_of(events_of, 1), "log-x-0")
    assert not tables.other_writers(prefix)
    ingest.ingest_batch(tables, batch_of(events_of, 2), "other-0")
    assert tables.other_writers(prefix)


# -- the tree of sketches -----------------------------------------------------------------------


class Node:
    def __init__(self, day, level=None, since=0):
        self.day, self.level, self.since = day, level, since


def test_any_range_is_few_nodes():
    first, last = date(2021, 1, 1), date(2024, 12, 31)
    days = [Node(first + timedelta(days=i)) for i in range((last - first).days + 1)]
    nodes = [Node(s, k) for k in range(1, sketch_tree.LEVELS + 1) for s in sketch_tree.starts(k, first, last)]
    rng = random.Random(1)
    for _ in range(60):
        a, b = sorted(rng.choices(days, k=2), key=lambda d: d.day)
        chosen, daily = sketch_tree.cover(a.day, b.day, nodes, days)
        covered = [n.day + timedelta(days=k) for n in chosen for k in range(1 << n.level)] + [d.day for d in daily]
        n = (b.day - a.day).days + 1
        assert sorted(covered) == [a.day + timedelta(days=k) for k in range(n)]
        assert len(chosen) + len(daily) <= 2 * n.bit_length()
    year, daily = sketch_tree.cover(date(2024, 1, 1), date(2024, 10, 20), nodes, days)
    assert len(year) + len(daily) <= 14


def test_late_days_are_read_beside_a_node():
    node, late, early = Node(date(2024, 1, 1), 1, since=5), Node(date(2024, 1, 2), since=7), Node(date(2024, 1, 1), since=3)
    node.day = sketch_tree._EPOCH + timedelta(days=(node.day - sketch_tree._EPOCH).days // 2 * 2)
    late.day, early.day = node.day + timedelta(days=1), node.day
    chosen, daily = sketch_tree.cover(node.day, late.day, [node], [late, early])
    assert chosen == [node] and daily == [late]
    assert sketch_tree.due(1, node.day, late.day, [node], [late, early]) == ([node], [node.day])
    assert sketch_tree.due(1, node.day, late.day, [node], [early]) == ([], [])


def test_ranges_from_the_tree_equal_the_fold_of_days(spark, tables):
    received = inputs.received(spark, SF_DIR).select(*EVENT_COLUMNS).filter("ts < '2024-01-13'")
    ingest.ingest_batch(tables, received.filter("event_id % 3 <> 0"), "b-0")
    first, last = date(2024, 1, 1), date(2024, 1, 12)
    assert tables.merge_sketch_tree(first, last) > 6 and tables.merge_sketch_tree(first, last) == 0

    def agree(ranges):
        snapshot = tables.snapshot()
        for a, b in ranges:
            tree = estimate(merge_sketches(snapshot.sketches_range(a, b), ["name"]))
            assert rows_of(tree) == rows_of(uniques_range(snapshot.sketch_deltas(), a, b))

    ranges = [(date(2024, 1, 3), date(2024, 1, 3)), (date(2024, 1, 2), date(2024, 1, 11)), (first, last)]
    agree(ranges)
    nodes = tables.snapshot().parts("sketch_nodes")
    whole = tables.snapshot().sketches_range(first, last)
    assert len(whole.inputFiles()) <= 6
    ingest.ingest_batch(tables, received.filter("event_id % 3 = 0"), "b-1")  # late for every node
    agree(ranges)
    assert tables.merge_sketch_tree(first, last) == len(nodes)
    agree(ranges)
    tables.compact_deltas(date(2024, 1, 9))  # the same rows in a new part make no node stale
    assert tables.merge_sketch_tree(first, last) == 0


# -- reads through a snapshot -------------------------------------------------------------------


def test_dashboard_reads_one_day_and_groups_it_once(spark, tables):
    received = inputs.received(spark, SF_DIR).select(*EVENT_COLUMNS)
    ingest.ingest_batch(tables, known_at(received, inputs.AS_OF), "b-0")
    snapshot = tables.snapshot()
    rollup, sketches = snapshot.rollup_today(inputs.AS_OF), snapshot.sketches_today(inputs.AS_OF)
    shown = dashboard.dashboard_stats(rollup, sketches, inputs.AS_OF)
    shown.collect()
    final = plan_of(shown).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert all("/day=2024-01-15/" in f for f in shown.inputFiles())
    for read in (filter_today(rollup, inputs.AS_OF), count_today(rollup, "click", inputs.AS_OF), shown):
        scans = [line for line in plan_of(read).split("\n") if "FileScan parquet" in line]
        assert scans and all("PartitionFilters: [isnotnull(day" in line and "/events" not in line for line in scans)


def test_recent_minutes_reach_back_over_midnight(events_of, tables):
    rows = [("1", "a", "u", "2024-01-02 23:58:00"), ("2", "a", "u", "2024-01-03 00:03:00")]
    ingest.ingest_batch(tables, events_of(*rows), "b-0")
    as_of = "2024-01-03 00:05:00"
    snapshot = tables.snapshot()
    shown = dashboard.dashboard_stats(snapshot.rollup_today(as_of), snapshot.sketches_today(as_of), as_of)
    assert rows_of(shown, "section", "minute", "count") == [
        ("series", "2024-01-02 23:58:00", 1), ("series", "2024-01-03 00:03:00", 1), ("total", None, 1), ("unique", None, 1),
    ]
