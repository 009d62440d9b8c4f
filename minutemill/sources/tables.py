"""Stored tables on plain Parquet: facts, additive deltas, known ids, merged sketches, finished batches.

Layout: `<root>/<table>/day=<day>/part=<name>/*.parquet` (ids: `bucket=`). Parts are written once. What
is live is said by the manifest, whose next generation, written last, shows all of a batch at once; a
crash before that leaves parts that nobody reads. Reads go through a snapshot: it hands Spark the folders of the
days that are asked for, so nothing else is listed and no list of batches is joined to the rows.
"""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutemill import schema
from minutemill.functions.timing import day_start, series_start, to_day, utc
from minutemill.operators import sketch_tree
from minutemill.operators.portable import portable_merge
from minutemill.operators.reconcile import PRINT_BUCKETS, PRINT_NUMBERS, fingerprint
from minutemill.operators.uniques import merge_sketches
from minutemill.sources import id_index
from minutemill.sources.manifest import Manifest, Part

_SCHEMAS: dict[str, T.StructType] = {
    "events": schema.EVENTS_TABLE,
    "minute_deltas": schema.MINUTE_DELTAS_TABLE,
    "sketch_deltas": schema.SKETCH_DELTAS_TABLE,
    "register_deltas": schema.REGISTER_DELTAS_TABLE,
    "sketch_nodes": schema.SKETCH_NODES_TABLE,
    "event_ids": schema.EVENT_IDS_TABLE,
    "quarantine": schema.QUARANTINE_TABLE,
    "batch_health": schema.STORED_HEALTH_TABLE,
}
_KEPT = ["parts", "received_print", "stored_print", "generation"]
_HEALTH = schema.BATCH_HEALTH_TABLE.fieldNames()


def _in_days(first: date | None, last: date | None):
    condition = F.lit(True)
    if first is not None:
        condition &= F.col("day") >= F.lit(first)
    if last is not None:
        condition &= F.col("day") <= F.lit(last)
    return condition


class Snapshot:
    """The tables as of one generation. All reads of a snapshot see the same batches, whatever is stored or
    compacted meanwhile. Its number is a token: `tables.snapshot(number)` gives the same rows again until
    their files are removed."""

    def __init__(self, tables: EventTables, generation: int | None = None):
        self.tables = tables
        self.generation = tables.manifest.newest(generation)

    def parts(self, table: str, first: date | None = None, last: date | None = None, condition=None) -> list[Part]:
        """Live parts of a table, with places between two days where these are given."""
        wanted = (F.col("table") == table) & _in_days(first, last)
        return self.tables.manifest.live(wanted if condition is None else wanted & condition, self.generation)

    def read(self, table: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """Rows of the days first..last: folders are chosen by the manifest, days once more by the scan."""
        rows = self.tables.read_parts(table, self.parts(table, first, last))
        return rows if first is None and last is None else rows.filter(_in_days(first, last))

    def events(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self.read("events", first, last)

    def minute_deltas(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self.read("minute_deltas", first, last)

    def sketch_deltas(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self.read("sketch_deltas", first, last)

    def register_deltas(self, first: date | None = None, last: date | None = None) -> DataFrame:
        return self.read("register_deltas", first, last)

    def quarantine(self) -> DataFrame:
        return self.read("quarantine")

    # -- what the dashboard asks for --------------------------------------------------------

    def rollup_today(self, as_of: datetime | str, minutes: float = 15) -> DataFrame:
        """Counters since the start of the day of `as_of`, or of the last minutes if that is earlier."""
        return self.minute_deltas(first=min(day_start(as_of), series_start(as_of, minutes)).date())

    def sketches_today(self, as_of: datetime | str) -> DataFrame:
        day = utc(as_of).date()
        return self.sketch_deltas(day, day)

    def sketches_range(self, first: date, last: date) -> DataFrame:
        """(name, sketch) whose union is that of the days first..last: the fewest merged nodes that cover whole
        runs of days, and the daily sketches of the other days and of what arrived after a node was made."""
        nodes = self.parts("sketch_nodes", first, last)
        days = self.parts("sketch_deltas", first, last)
        chosen, daily = sketch_tree.cover(first, last, nodes, days)
        merged = self.tables.read_parts("sketch_nodes", chosen).select("name", "sketch")
        return merged.unionAll(self.tables.read_parts("sketch_deltas", daily).select("name", "sketch"))


class EventTables:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self._written: dict[str, list[Part]] = {}  # parts of batches that are not committed yet
        self._prints: dict[str, list[int]] = {}  # of the events that these have stored
        self._lock = threading.Lock()

    def create(self) -> EventTables:
        """Start an empty manifest, if there is none."""
        self.manifest.create()
        return self

    def snapshot(self, generation: int | None = None) -> Snapshot:
        return Snapshot(self, generation)

    def read_parts(self, table: str, parts: Sequence[Part]) -> DataFrame:
        wanted = _SCHEMAS[table]
        if not parts:
            return self.spark.createDataFrame([], wanted)
        base = f"{self.root}/{table}"
        paths = [f"{self.root}/{p.path}" for p in parts]
        return self.spark.read.schema(wanted).option("basePath", base).parquet(*paths).select(*wanted.fieldNames())

    # -- writing one batch ------------------------------------------------------------------

    def _write(
        self, table: str, rows: DataFrame, by: str, order: Sequence[str] = (), options: dict | None = None,
        printed: bool = False, **entry,
    ) -> tuple[int, list[Part], list[int] | None]:
        """Write rows as one new part for each value of `by`; returns the number of rows, the parts and, if asked
        for, the fingerprint of event_id. All come from the write itself, by observed metrics, and not from
        another pass."""
        name, seen = f"p-{uuid.uuid4().hex}", Observation()
        placed = rows.withColumn("part", F.lit(name)).sortWithinPartitions(by, "part", *order)
        metrics = F.count(F.lit(1)).alias("rows"), F.collect_set(F.struct(F.col(by).cast("string"))).alias("places")
        if printed:
            metrics += (fingerprint().alias("print"),)
        writer = placed.observe(seen, *metrics).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.options(**(options or {})).partitionBy(by, "part").parquet(f"{self.root}/{table}")
        parts = []
        for (value,) in seen.get["places"]:
            where = {"day": date.fromisoformat(value)} if by == "day" else {by: int(value)}
            parts.append(Part(table, f"{by}={value}", name, **where, **entry))
        return seen.get["rows"], parts, seen.get.get("print")

    def _store(self, table: str, rows: DataFrame, batch_id: str, by: str = "day", order: Sequence[str] = (), **more) -> int:
        n, parts, ids = self._write(table, rows, by, order, batch_id=batch_id, **more)
        with self._lock:
            if ids is not None:
                self._prints[batch_id] = list(ids)
            self._written[batch_id] = [p for p in self._written.get(batch_id, []) if p.table != table] + parts
        return n

    def write_events(self, fresh: DataFrame, batch_id: str) -> int:
        """Store the new events of a batch, clustered by day and name; returns their number.

        The rebalance brings a day's rows together, splits a day that is too big for one task and
        joins small ones; sorting lets a filter on name skip row groups.
        """
        rows = fresh.select(*schema.EVENT_COLUMNS, F.lit(batch_id).alias("batch_id"), to_day("ts").alias("day"))
        return self._store("events", rows.hint("rebalance", "day"), batch_id, order=("name", "ts"), printed=True)

    def write_minute_deltas(self, rollup: DataFrame, batch_id: str) -> int:
        """Store what a batch adds to the minute counters."""
        rows = rollup.select("name", "minute", "n", to_day("minute").alias("day"))
        return self._store("minute_deltas", rows.hint("rebalance", "day"), batch_id, order=("name", "minute"))

    def write_sketch_deltas(self, sketches: DataFrame, batch_id: str) -> int:
        """Store the users a batch adds per (name, day)."""
        rows = sketches.select("name", "sketch", "day")
        return self._store("sketch_deltas", rows.hint("rebalance", "day"), batch_id, order=("name",))

    def write_register_deltas(self, registers: DataFrame, batch_id: str) -> int:
        """Store the users a batch adds per (name, day) as portable registers."""
        rows = registers.select("name", "register", "rank", "day")
        return self._store("register_deltas", rows.hint("rebalance", "day"), batch_id, order=("name",))

    def write_event_ids(self, events: DataFrame, batch_id: str) -> int:
        """Add the ids of a batch to the index of known ids, unsorted into buckets until they are folded."""
        rows = id_index.hashed_ids(events).withColumn("bucket", F.lit(id_index.RECENT))
        return self._store("event_ids", rows.select(*schema.EVENT_IDS_TABLE.fieldNames()), batch_id, "bucket", ("id_hash",))

    def write_quarantine(self, rejected: DataFrame, batch_id: str) -> int:
        """Set rejected lines aside with their reason, under the day they are stored."""
        today = datetime.now(timezone.utc).date()
        rows = rejected.select("value", "reason", F.lit(batch_id).alias("batch_id"), F.lit(today).alias("day"))
        return self._store("quarantine", rows, batch_id)

    def commit(
        self, batch_id: str, batch_size: int, inserted: int, took_seconds: float, ts, error: str | None = None,
        received_print: Sequence[int] | None = None,
    ) -> None:
        """Make what was written for a batch visible, in place of an earlier attempt; the same row is its health
        record; `received_print` is the fingerprint of the ids it was given. With an `error` the attempt is put on record and nothing becomes visible."""
        with self._lock:
            parts, stored_print = self._written.pop(batch_id, []), self._prints.pop(batch_id, None)
        health = {
            "batch_id": batch_id, "batch_size": batch_size, "inserted": inserted, "duplicates": batch_size - inserted,
            "took_seconds": took_seconds, "error": error, "ts": ts or datetime.now(timezone.utc),
            "received_print": None if received_print is None else list(received_print), "stored_print": stored_print,
        }
        if self.manifest.commit(parts if error is None else [], replaces=batch_id if error is None else None, **health):
            self._checkpoint()

    def _checkpoint(self) -> None:
        """Health of the batches since the last checkpoint becomes rows of a table, then the list is written."""
        placed = self.manifest.batches().select(*_HEALTH, *_KEPT, to_day("ts").alias("day"))
        _, parts, _ = self._write("batch_health", placed.coalesce(1), "day", ("batch_id",))
        self.manifest.checkpoint(parts)

    def _live(self, table: str) -> list[Part]:
        return self.manifest.live(F.col("table") == table)

    def _parts_of(self, batch_id: str, table: str | None = None) -> list[Part]:
        own = F.col("batch_id") == F.lit(batch_id)
        return self.manifest.live(own if table is None else own & (F.col("table") == table))

    def _attempt(self, batch_id: str) -> tuple[int | None, int]:
        """Parts that a batch has stored, None if it is not visible, and how many of them are not folded yet."""
        own = F.col("batch_id") == F.lit(batch_id)
        view = self.manifest.look((F.col("table") == "batch_health") | own)
        told = [r for r in view.commits if r.batch_id == batch_id]
        earlier = [p for p in view.parts if p.table == "batch_health"]
        if not told and earlier:
            told = self.read_parts("batch_health", earlier).filter(own).select("generation", "parts", "error").collect()
        told = [r for r in told if r.error in (None, "withdrawn")]  # failed attempts changed nothing
        last = max(told, key=lambda r: r.generation, default=None)
        visible = last is not None and last.error is None
        return last.parts if visible else None, len(view.parts) - len(earlier)

    def is_committed(self, batch_id: str) -> bool:
        """Whether a batch is visible."""
        return self._attempt(batch_id)[0] is not None

    def check_replaceable(self, batch_id: str) -> None:
        """Refuse a batch of which a part was folded into a compacted one: its rows can't be taken out again."""
        stored, left = self._attempt(batch_id)
        if stored is not None and left < stored:
            raise ValueError(f"batch {batch_id} is part of a compacted day and can't be replaced")

    def withdraw(self, batch_id: str) -> None:
        """Make a batch invisible again."""
        self.check_replaceable(batch_id)
        now = datetime.now(timezone.utc)
        self.manifest.commit([], replaces=batch_id, batch_id=batch_id, error="withdrawn", ts=now)

    # -- reading ----------------------------------------------------------------------------

    def batch_health(self) -> DataFrame:
        """The last outcome of every batch, and every failed attempt."""
        return self._outcomes().select(*_HEALTH)

    def _outcomes(self) -> DataFrame:
        stored = self.read_parts("batch_health", self._live("batch_health"))
        columns = [c for c in (*_HEALTH, *_KEPT) if c != "batch_id"]
        rows = stored.select("batch_id", *columns).unionAll(self.manifest.batches().select("batch_id", *columns))
        withdrawn = F.coalesce(F.col("error") == "withdrawn", F.lit(False))
        attempt = F.when(F.col("error").isNotNull() & ~withdrawn, F.col("generation")).alias("_attempt")
        last = rows.groupBy("batch_id", attempt).agg(F.max_by(F.struct(*columns), "generation").alias("_h"))
        return last.select("_h.*", "batch_id").filter(F.coalesce(F.col("error") != "withdrawn", F.lit(True)))

    def fingerprints(self) -> tuple[list[int], list[int]]:
        """Of the ids that all visible batches have received, and of those they have stored. A batch without
        them on record counts as none, so that its ids differ and are compared."""
        visible = self._outcomes().filter(F.col("error").isNull())
        sums = []
        for column in ("received_print", "stored_print"):
            numbers = visible.select(F.posexplode(column).alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
            found = {r.place: r.n for r in numbers.collect()}
            sums.append([found.get(i, 0) for i in range(PRINT_BUCKETS * PRINT_NUMBERS)])
        return sums[0], sums[1]

    def events(self, other_than: str | None = None) -> DataFrame:
        """Stored events, without those of an earlier attempt at batch `other_than`."""
        rows = self.snapshot().events()
        return rows if other_than is None else rows.filter(F.col("batch_id") != other_than)

    def events_of(self, batch_id: str) -> DataFrame:
        """What a batch has just written, committed or not; only its own folders are listed."""
        with self._lock:
            parts = [p for p in self._written.get(batch_id, []) if p.table == "events"]
        return self.read_parts("events", parts or self._parts_of(batch_id, "events"))

    def known_ids(self, batch: DataFrame, other_than: str | None = None) -> DataFrame:
        """event_id of the stored ids that `batch` may hold: see `id_index.probe`."""
        return id_index.probe(self, batch, other_than)

    def other_writers(self, prefix: str) -> bool:
        """Whether there are known ids of batches that don't begin with `prefix`, or folded ones, whose batch is
        not known any more. One look at the manifest."""
        other = (F.col("table") == "event_ids") & ~F.coalesce(F.col("batch_id").startswith(prefix), F.lit(False))
        return bool(self.manifest.live(other))

    def quarantine(self) -> DataFrame:
        return self.snapshot().quarantine()

    def minute_deltas(self) -> DataFrame:
        return self.snapshot().minute_deltas()

    def sketch_deltas(self) -> DataFrame:
        return self.snapshot().sketch_deltas()

    def register_deltas(self) -> DataFrame:
        return self.snapshot().register_deltas()

    # -- compaction -------------------------------------------------------------------------

    def _fold(self, day: date, merges: dict[str, tuple[Callable, Sequence[str]]]) -> str | None:
        snapshot = self.snapshot()
        added, removed = [], []
        for table, (merge, order) in merges.items():
            parts = snapshot.parts(table, day, day)
            if all(p.batch_id is None for p in parts) and len(parts) < 2:
                continue
            merged = merge(self.read_parts(table, parts)).hint("rebalance", "day")
            names = _SCHEMAS[table].fieldNames()
            added += self._write(table, merged.select(*names), "day", order, since=max(p.since for p in parts))[1]
            removed += parts
        if not removed:
            return None
        self.manifest.commit(added, removed)
        return added[0].part

    def compact_deltas(self, day: date) -> str | None:
        """Rewrite a day's deltas as one row per key; returns the name of the new form.

        The new form is written beside the old one and takes its place, in all tables, with the next
        generation. A batch that arrives later adds deltas on top and is folded by the next call. A crash
        before that leaves readers on the old form.
        """
        counters = lambda d: d.groupBy("name", "minute", "day").agg(F.sum("n").alias("n"))
        return self._fold(
            day,
            {
                "minute_deltas": (counters, ("name", "minute")),
                "sketch_deltas": (lambda d: merge_sketches(d, ["name", "day"]), ("name",)),
                "register_deltas": (lambda d: portable_merge(d, ["name", "day"]), ("name",)),
            },
        )

    def crowded_days(self, table: str, most: int) -> list[date]:
        """Days with more than `most` parts."""
        held = Counter(p.day for p in self._live(table))
        return sorted(day for day, n in held.items() if n > most)

    def compact_events(self, day: date) -> str | None:
        """Rewrite a day's events from the files of many batches into few, clustered by name."""
        return self._fold(day, {"events": (lambda d: d, ("name", "ts"))})

    def compact_ids(self) -> int:
        """Fold the ids of recent batches into their buckets; returns the number of parts folded."""
        return id_index.fold(self)

    def merge_sketch_tree(self, first: date, last: date) -> int:
        """Merge daily sketches into nodes of 2, 4, 8, ... days, for nodes within first..last that are missing or
        older than what has arrived since; returns the number of nodes. See `operators/sketch_tree`."""
        snapshot = self.snapshot()
        tables = F.col("table").isin("sketch_nodes", "sketch_deltas") & _in_days(first, last)
        parts = self.manifest.live(tables, snapshot.generation)
        nodes = [p for p in parts if p.table == "sketch_nodes"]
        days = [p for p in parts if p.table == "sketch_deltas"]
        made, replaced = [], []
        for level in range(1, sketch_tree.LEVELS + 1):
            stale, starts = sketch_tree.due(level, first, last, nodes, days)
            if not starts:
                continue
            sources = [sketch_tree.cover(s, sketch_tree.end(s, level), nodes, days) for s in starts]
            children = self.read_parts("sketch_nodes", [p for chosen, _ in sources for p in chosen])
            daily = self.read_parts("sketch_deltas", [p for _, rest in sources for p in rest])
            start = sketch_tree.start_of(F.col("day"), level).alias("day")
            rows = children.select("name", start, "sketch").unionAll(daily.select("name", start, "sketch"))
            merged = merge_sketches(rows, ["name", "day"]).withColumn("level", F.lit(level))
            names = _SCHEMAS["sketch_nodes"].fieldNames()
            written = self._write(
                "sketch_nodes", merged.select(*names).hint("rebalance", "day"), "day", ("name",), level=level, since=snapshot.generation
            )[1]
            nodes = [n for n in nodes if n not in stale] + written
            made, replaced = made + written, replaced + stale
        if made:
            self.manifest.commit(made, replaced)
        return len(made)

    def remove_dead(self, grace: timedelta = timedelta(days=7)) -> int:
        """Delete files of replaced, compacted and never finished parts that are older than `grace`."""
        return self.manifest.remove_dead(_SCHEMAS, grace)


def compact_rollup(deltas: DataFrame) -> DataFrame:
    """Minute deltas to one row per (name, minute, day)."""
    return deltas.groupBy("name", "minute", "day").agg(F.sum("n").alias("n"))

