"""From the event log to stored events, minute counters and user sketches, each event once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from minutemill.operators.dedupe import dedupe_stored
from minutemill.operators.portable import import_portable_sketches, portable_registers
from minutemill.operators.reconcile import fingerprint
from minutemill.operators.rollup import merge_rollups, minute_rollup
from minutemill.operators.uniques import uniques_daily
from minutemill.operators.validate import validate_events, with_reason
from minutemill.schema import EVENT_COLUMNS
from minutemill.session import stream_partitions
from minutemill.sources.event_log import decode_records
from minutemill.sources.tables import EventTables
from minutemill.streaming.live import append_stream, dedupe_stream, thin_recent_copies


# Micro-batches after which a stream folds their ids into the buckets of the id index.
FOLD_EVERY = 100


def batch_name(number: int, writer: str = "log") -> str:
    return f"{writer}-{number:012d}"


def ingest_batch(
    tables: EventTables,
    events: DataFrame,
    batch_id: str,
    uniques_over: str = "received",
    history: Callable[[DataFrame], DataFrame] | None = None,
    portable: bool = False,
) -> None:
    """Store one batch of events and what it adds to counters and sketches.

    Repeating a batch_id replaces its earlier attempt: readers see all of the old one until they see all of the
    new one. Known ids are looked up in the id index; `history` takes the stored events instead and may
    narrow them (for example to recent days) where a bounded memory is acceptable. `portable` also keeps the
    users as portable registers. An attempt that fails is put on record and the error goes on.
    """
    tables.check_replaceable(batch_id)
    received = events.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _store(tables, received, batch_id, uniques_over, history, portable)
    finally:
        received.unpersist()


@contextmanager
def _on_record(tables: EventTables, batch_id: str, size: Callable[[], int]) -> Iterator[None]:
    """Put a failed attempt on record, with the rows it would have stored."""
    started = time.monotonic()
    try:
        yield
    except Exception as failure:
        took, said = time.monotonic() - started, f"{type(failure).__name__}: {failure}"[:500]
        try:
            tables.commit(batch_id, size(), 0, took, datetime.now(timezone.utc), error=said)
        except Exception:  # the store itself is out of reach: the first failure is the one to tell
            pass
        raise


def _together(*steps: Callable[[], object]) -> None:
    """Run independent writes at the same time, so that one's last tasks leave no cores idle."""
    failures: list[BaseException] = []

    def guarded(step: Callable[[], object]) -> None:
        try:
            step()
        except BaseException as failure:  # raised below, when all have ended
            failures.append(failure)

    threads = [InheritableThread(target=guarded, args=(step,)) for step in steps]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if failures:
        raise failures[0]


def _store(
    tables: EventTables,
    received: DataFrame,
    batch_id: str,
    uniques_over: str = "received",
    history: Callable[[DataFrame], DataFrame] | None = None,
    portable: bool = False,
    only_new: bool = False,
    micro: bool = False,
    beside: tuple[Callable[[], object], ...] = (),
) -> None:
    """`received` is cached: counting it fills the cache, whose measured size then decides how its
    ids are joined to history. With `only_new` the caller has left out all known ids already; `micro` is said of a
    stream's micro-batches."""
    if uniques_over not in ("received", "inserted"):
        raise ValueError("uniques_over must be 'received' or 'inserted'")
    size = 0
    with _on_record(tables, batch_id, lambda: size):
        started = time.monotonic()
        size, ids = received.agg(F.count(F.lit(1)), fingerprint()).first()
        if only_new:
            fresh = received
        elif history is None:
            fresh = dedupe_stored(received, tables.known_ids(received, other_than=batch_id), micro)
        else:
            fresh = dedupe_stored(received, history(tables.events(other_than=batch_id)))

        def store_users(events: DataFrame) -> None:
            tables.write_sketch_deltas(uniques_daily(events), batch_id)
            if portable:
                tables.write_register_deltas(portable_registers(events), batch_id)

        inserted = 0

        def store_events() -> None:
            nonlocal inserted
            inserted = tables.write_events(fresh, batch_id)
            # Counters and ids follow what was stored, read back as few columns of this batch's files.
            stored = tables.events_of(batch_id)
            steps = [
                lambda: tables.write_minute_deltas(minute_rollup(stored), batch_id),
                lambda: tables.write_event_ids(stored, batch_id),
            ]
            if uniques_over == "inserted":
                steps.append(lambda: store_users(stored))
            _together(*steps)

        users = (lambda: store_users(received),) if uniques_over == "received" else ()
        _together(store_events, *users, *beside)
        now = datetime.now(timezone.utc)
        tables.commit(batch_id, size, inserted, time.monotonic() - started, now, received_print=ids)


def import_history(
    tables: EventTables,
    batch_id: str,
    events: DataFrame | None = None,
    counters: DataFrame | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame | None:
    """Take over existing tables: stored events, minute counters and portable sketch buffers.

    Counters and sketches are taken as they are and not derived from the events, of which those are left out
    whose id is stored already. Returns the sketches that could not be read.
    """
    tables.check_replaceable(batch_id)
    started, size, inserted, rejected = time.monotonic(), 0, 0, None
    with _on_record(tables, batch_id, lambda: size):
        if events is not None:
            size = events.count()
            fresh = dedupe_stored(events, tables.known_ids(events, other_than=batch_id))
            inserted = tables.write_events(fresh, batch_id)
            tables.write_event_ids(tables.events_of(batch_id), batch_id)
        if counters is not None:
            tables.write_minute_deltas(counters, batch_id)
        if sketches is not None:
            registers, rejected = import_portable_sketches(sketches)
            tables.write_register_deltas(registers, batch_id)
        tables.commit(batch_id, size, inserted, time.monotonic() - started, datetime.now(timezone.utc))
    return rejected


def ingest_records(tables: EventTables, records: DataFrame, batch_id: str, **options) -> None:
    """Decode and check raw log records once, set bad ones aside, store the rest. A repeated batch_id replaces
    its earlier attempt as a whole."""
    judged = with_reason(decode_records(records)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rejected = judged.filter(F.col("reason").isNotNull())
        accepted = judged.filter(F.col("reason").isNull()).select(*EVENT_COLUMNS)
        _store(tables, accepted, batch_id, beside=(lambda: tables.write_quarantine(rejected, batch_id),), **options)
    finally:
        judged.unpersist()


def ingest_stream(
    records: DataFrame,
    tables: EventTables,
    checkpoint: str,
    writer: str = "log",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start the stream. Batches of the log are stored until they succeed and are never dropped.

    A crash repeats the unfinished batch under the same name; what the first attempt left is never read. A batch
    that was committed before the crash is not touched again. Names hold the query's id, which the checkpoint
    keeps: with a new checkpoint, numbers start again but names do not. Every `FOLD_EVERY` batches the ids of
    the last ones are folded into the buckets of the id index.
    """

    def store(batch: DataFrame, name: str, _: str) -> None:
        ingest_records(tables, batch, name, micro=True, **options)

    return _start(tables, records, store, checkpoint, writer, trigger)


def _start(
    tables: EventTables, rows: DataFrame, store: Callable[[DataFrame, str, str], None], checkpoint: str, writer: str,
    trigger: dict | None,
) -> StreamingQuery:
    """Run store(batch, batch name, prefix of this query's batch names) on every micro-batch.

    Only the first batch after a start can be one that was stored before. State and what is made of a batch are
    dealt to as many tasks as the cluster runs well, however many partitions the session gives to whole tables.
    """
    known, prefix, first = threading.Event(), [], []

    def with_name(batch: DataFrame, number: int) -> None:
        known.wait()
        name = batch_name(number, prefix[0])
        if first or not tables.is_committed(name):
            store(batch, name, f"{prefix[0]}-")
        first.append(name)
        if len(first) % FOLD_EVERY == 0:
            tables.compact_ids()

    writer = rows.writeStream.foreachBatch(with_name).option("checkpointLocation", checkpoint)
    with stream_partitions(rows.sparkSession):
        query = writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    prefix.append(f"{writer}-{query.id}")
    known.set()
    return query


def ingest_stream_with_state(
    records: DataFrame,
    tables: EventTables,
    checkpoint: str,
    writer: str = "log",
    trigger: dict | None = None,
    portable: bool = False,
) -> StreamingQuery:
    """Like `ingest_stream`, with all known ids in the stream's state instead of the events table.

    A micro-batch then costs what it holds and does not read history: the form for small, frequent
    batches over years of ids. State lives in RocksDB and is spread by event_id. Uniques follow
    the stored events and bad records are left to `quarantine_stream`. Events that other queries or an
    earlier checkpoint have stored are not in the state: every batch looks in the manifest for ids of others
    and, where there are any, is compared with the id index as well.
    """

    def store(batch: DataFrame, name: str, prefix: str) -> None:
        received = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            alone = not tables.other_writers(prefix)
            _store(tables, received, name, uniques_over="inserted", portable=portable, only_new=alone, micro=True)
        finally:
            received.unpersist()

    accepted, _ = validate_events(decode_records(records))
    return _start(tables, dedupe_stream(accepted.select(*EVENT_COLUMNS)), store, checkpoint, writer, trigger)


def ingest_stream_bounded(
    records: DataFrame, tables: EventTables, checkpoint: str, horizon: str, writer: str = "log",
    trigger: dict | None = None, portable: bool = False,
) -> StreamingQuery:
    """Like `ingest_stream`, in two tiers: copies that follow within `horizon` end in state, which forgets an id
    after that; what comes through is compared with the id index. No event is lost and a copy never counts,
    however late it is and however batches fall; the horizon says only how many copies the index is spared
    and how much state is held. Uniques follow the stored events.
    """

    def store(batch: DataFrame, name: str, _: str) -> None:
        ingest_batch_once(tables, batch, name, portable, micro=True)

    accepted, _ = validate_events(decode_records(records))
    once = thin_recent_copies(accepted.select(*EVENT_COLUMNS), horizon)
    return _start(tables, once, store, checkpoint, writer, trigger)


def ingest_batch_once(
    tables: EventTables, events: DataFrame, batch_id: str, portable: bool = False, micro: bool = False
) -> None:
    """Store a batch that was not stored before, with uniques over what it adds."""
    received = events.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _store(tables, received, batch_id, uniques_over="inserted", portable=portable, micro=micro)
    finally:
        received.unpersist()


# -- live counters ------------------------------------------------------------------------------

# A day is folded when it has come to this many parts of counters.
MOST_PARTS = 16


def live_rollup(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, horizon: str = "1 hour"
) -> StreamingQuery:
    """Keep minute counters up to date, every event_id once, without storing the events.

    A micro-batch adds its new events to the counters as deltas, so no counter is held in state: a minute
    is closed when nothing comes for it any more, and a late event is one more delta. State holds the ids of
    `horizon`, older ids are in the id index. Days with many deltas and recent ids are folded on the way, so
    files stay few. A repeated batch adds nothing.
    """
    tables = EventTables(events.sparkSession, path).create()

    def store(batch: DataFrame, name: str, _: str) -> None:
        received = batch.persist(StorageLevel.MEMORY_AND_DISK)
        size = 0
        try:
            with _on_record(tables, name, lambda: size):
                started = time.monotonic()
                size = received.count()
                fresh = dedupe_stored(received, tables.known_ids(received), micro=True).select("event_id", "name", "ts")
                fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    inserted = tables.write_event_ids(fresh, name)
                    tables.write_minute_deltas(minute_rollup(fresh), name)
                finally:
                    fresh.unpersist()
                tables.commit(name, size, inserted, time.monotonic() - started, datetime.now(timezone.utc))
        finally:
            received.unpersist()
        for day in tables.crowded_days("minute_deltas", MOST_PARTS):
            tables.compact_deltas(day)

    once = thin_recent_copies(events.select(*EVENT_COLUMNS), horizon)
    return _start(tables, once, store, checkpoint, "live", trigger)


def read_live_rollup(spark: SparkSession, path: str) -> DataFrame:
    """(name, minute, n) as of the last batch."""
    return merge_rollups(EventTables(spark, path).minute_deltas())


def quarantine_stream(
    records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Rejected records with their reason, appended to Parquet files."""
    _, rejected = validate_events(decode_records(records))
    return append_stream(rejected.select("value", "reason"), path, checkpoint, trigger)


def recent_days(days: int, newest: datetime) -> Callable[[DataFrame], DataFrame]:
    """A bounded history for `ingest_batch`: only ids stored within `days` days of `newest`."""
    return lambda seen: seen.filter(F.col("day") >= F.date_sub(F.lit(newest.date()), days))
