"""Every operator as a query over a data folder, by its inventory key."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from fractions import Fraction
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.functions.client import client_key as key_of_client
from minutemill.functions.hashing import portable_hash as hash_of
from minutemill.functions.properties import default_properties as with_properties
from minutemill.functions.properties import map_properties as json_of_map
from minutemill.functions.timing import instant, known_at, to_day
from minutemill.operators import dedupe, health, portable, quota, rollup, series, uniques, validate
from minutemill.operators.reconcile import reconcile as reconcile_names
from minutemill.operators.reconcile import reconcile_tables as reconcile_stored
from minutemill.plans import dashboard, inputs
from minutemill.plans.inputs import AS_OF
from minutemill.schema import EVENT_COLUMNS
from minutemill.session import prepare, scratch_path
from minutemill.sources import event_log, json_lines, publish_batches
from minutemill.sources.event_log import EventLog
from minutemill.sources.tables import EventTables, Snapshot, compact_rollup
from minutemill.streaming import ingest, live

Query = Callable[[SparkSession, str], DataFrame]

NAME = "click"
ONCE = {"availableNow": True}
# Arguments of the quota audits, shared with the oracle.
WINDOW_LIMIT = 1
BUCKET_RATE = Fraction(1, 20)
BUCKET_BURST = 2
RANGE = (date(2024, 1, 8), date(2024, 1, 14))
COMPACTED_DAY = date(2024, 1, 15)

QUERIES: dict[str, Query] = {}


# Results are compared across engines: timestamps without a zone, as in the input files, and days as
# text, because clients show a date column in different ways.
_SHOWN_AS = {"timestamp": "timestamp_ntz", "date": "string"}


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(_SHOWN_AS.get(t, t)).alias(c) for c, t in df.dtypes])


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(build(prepare(spark), sf_dir))

    QUERIES[build.__name__] = run
    return run


# -- shared steps ---------------------------------------------------------------------------


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.received(spark, sf_dir).select(*EVENT_COLUMNS)


_STORED: dict[tuple[str, str], tuple[str, int]] = {}
_MONTH = (date(2024, 1, 1), date(2024, 1, 31))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[EventTables, Snapshot]:
    """Tables with all deliveries, and their snapshot as it stood at AS_OF.

    What had arrived by AS_OF is one batch, the rest another, stored once for a session and data folder; the
    reads below start from these tables, as those of a dashboard do.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        tables = EventTables(spark, scratch_path(spark, "stored")).create()
        received = _received(spark, sf_dir)
        ingest.ingest_batch(tables, known_at(received, AS_OF), ingest.batch_name(0))
        generation = tables.snapshot().generation
        ingest.ingest_batch(tables, received.filter(F.col("ts") > instant(AS_OF)), ingest.batch_name(1))
        tables.merge_sketch_tree(*_MONTH)
        _STORED[key] = tables.root, generation
    root, generation = _STORED[key]
    tables = EventTables(spark, root)
    return tables, tables.snapshot(generation)


def _rollup_now(spark: SparkSession, sf_dir: str, minutes: float = 15) -> DataFrame:
    """Stored counters of the day of AS_OF, and of the minutes before if they reach back further."""
    return _stored(spark, sf_dir)[1].rollup_today(AS_OF, minutes)


def _sketches_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[1].sketches_today(AS_OF)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_lines.parse_event_json(inputs.raw_lines(spark, sf_dir))


def _log_of_deliveries(spark: SparkSession, sf_dir: str, root: str) -> EventLog:
    """A log on files: all events, then the repeated deliveries, in later micro-batches."""
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    again = _received(spark, sf_dir).filter(F.col("event_id").cast("long") % 5 == 0)
    event_log.write_event_log(again, log)
    return log


def _event_stream(spark: SparkSession, log: EventLog) -> DataFrame:
    return event_log.decode_records(event_log.read_event_log(spark, log)).select(*EVENT_COLUMNS)


# -- sources and sinks ----------------------------------------------------------------------


@query
def parse_event_json(spark, sf_dir):
    return _parsed(spark, sf_dir).select("line_id", "malformed", "event_id", "name", "distinct_id", "properties")


@query
def explode_event_batches(spark, sf_dir):
    return publish_batches.explode_event_batches(inputs.publish_batches(spark, sf_dir))


@query
def write_event_log(spark, sf_dir):
    log = EventLog("json", scratch_path(spark, "log"))
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    return event_log.read_event_log(spark, log, streaming=False).select("key", "value")


@query
def read_event_log(spark, sf_dir):
    root = scratch_path(spark, "log")
    log = EventLog("json", f"{root}/log")
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    stream = _event_stream(spark, log)
    live.append_stream(stream, f"{root}/read", f"{root}/checkpoint", ONCE).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/read")


def _two_batches(spark, sf_dir) -> EventTables:
    """Tables after one batch with all deliveries and a second batch that repeats it."""
    tables = EventTables(spark, scratch_path(spark, "tables")).create()
    for number in range(2):
        ingest.ingest_batch(tables, _received(spark, sf_dir), ingest.batch_name(number))
    return tables


@query
def write_events(spark, sf_dir):
    return _two_batches(spark, sf_dir).events().select(*EVENT_COLUMNS, "day", "batch_id")


def _delta_tables(spark, sf_dir) -> EventTables:
    """Counters and sketches of events without a user, then of all others."""
    tables = EventTables(spark, scratch_path(spark, "tables")).create()
    events = inputs.events(spark, sf_dir)
    parts = [events.filter(F.col("distinct_id") == ""), uniques.filter_has_user(events)]
    for number, part in enumerate(parts):
        batch_id = ingest.batch_name(number)
        tables.write_minute_deltas(rollup.minute_rollup(part), batch_id)
        tables.write_sketch_deltas(uniques.uniques_daily(part), batch_id)
        tables.commit(batch_id, 0, 0, 0.0, None)
    return tables


@query
def write_minute_deltas(spark, sf_dir):
    return _delta_tables(spark, sf_dir).minute_deltas().select("name", "minute", "n", "day")


@query
def write_sketch_deltas(spark, sf_dir):
    deltas = _delta_tables(spark, sf_dir).sketch_deltas()
    return uniques.estimate(uniques.merge_sketches(deltas.select("name", "day", "sketch")))


@query
def compact_deltas(spark, sf_dir):
    """Live rows and their sum per day after one day was compacted."""
    tables = _delta_tables(spark, sf_dir)
    tables.compact_deltas(COMPACTED_DAY)
    return tables.minute_deltas().groupBy("day").agg(F.count("*").alias("stored_rows"), F.sum("n").alias("n"))


# -- projections and filters ----------------------------------------------------------------


@query
def validate_events(spark, sf_dir):
    return validate.with_reason(_parsed(spark, sf_dir)).select(
        "line_id", F.coalesce("reason", F.lit("accepted")).alias("reason")
    )


@query
def reject_report(spark, sf_dir):
    report = publish_batches.reject_report(inputs.publish_batches(spark, sf_dir))
    shown = F.transform("rejected", lambda r: F.concat_ws(":", r["index"].cast("string"), r["reason"]))
    return report.select("batch_id", "accepted", F.array_join(shown, "; ").alias("rejected"))


@query
def reject_counts(spark, sf_dir):
    """Calls over the quota are turned away first; the rest are parsed and checked."""
    calls = inputs.raw_lines(spark, sf_dir).withColumnRenamed("line_id", "request_id")
    second = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("request_id") % 600)
    timed = calls.select("request_id", "value", "client", second.alias("ts"))
    judged = quota.fixed_window_quota(timed, WINDOW_LIMIT).drop("ts")
    parsed = json_lines.parse_event_json(judged)
    reason = F.when(~F.col("allowed"), F.lit("rate_limited")).otherwise(validate.reject_reason(parsed))
    return validate.reject_counts(parsed.withColumn("reason", reason))


@query
def stamp_ingest_time(spark, sf_dir):
    """One event in three comes without a time and takes that of its arrival."""
    rows = inputs.events(spark, sf_dir).withColumn("timestamp", F.col("ts") + F.expr("INTERVAL 2 SECONDS"))
    missing = rows.withColumn("ts", F.when(F.col("event_id").cast("long") % 3 != 0, F.col("ts")))
    return event_log.stamp_ingest_time(missing).select("event_id", "ts")


@query
def default_properties(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    sparse = rows.withColumn("properties", F.when(F.col("event_id").cast("long") % 3 != 0, F.col("properties")))
    return with_properties(sparse).select("event_id", "properties")


@query
def map_properties(spark, sf_dir):
    there = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    mapped = F.when(F.col("event_id") % 3 != 0, there)
    return inputs.source_events(spark, sf_dir).select("event_id", json_of_map(mapped).alias("properties"))


@query
def filter_name(spark, sf_dir):
    return rollup.filter_name(inputs.events(spark, sf_dir), NAME)


@query
def filter_today(spark, sf_dir):
    return rollup.filter_today(_rollup_now(spark, sf_dir), AS_OF).select("name", "minute", "n")


@query
def filter_last_minutes(spark, sf_dir):
    return rollup.filter_last_minutes(_rollup_now(spark, sf_dir, 90.9), AS_OF, 90.9).select("name", "minute", "n")


@query
def filter_has_user(spark, sf_dir):
    return uniques.filter_has_user(inputs.events(spark, sf_dir)).select("event_id", "distinct_id")


@query
def client_key(spark, sf_dir):
    return inputs.callers(spark, sf_dir).select(
        "request_id", key_of_client(F.col("api_key"), F.col("remote_addr")).alias("client")
    )


# -- joins and de-duplication ---------------------------------------------------------------


@query
def new_events_only(spark, sf_dir):
    """All events against a history that holds one id in three."""
    events = inputs.events(spark, sf_dir)
    history = inputs.source_events(spark, sf_dir).filter(F.col("event_id") % 3 == 0)
    seen = history.select(F.col("event_id").cast("string").alias("event_id"))
    return dedupe.new_events_only(events, seen)


@query
def dedupe_batch(spark, sf_dir):
    return dedupe.dedupe_batch(_received(spark, sf_dir))


@query
def dedupe_stored(spark, sf_dir):
    history = inputs.source_events(spark, sf_dir).filter(F.col("event_id") % 3 == 0)
    seen = history.select(F.col("event_id").cast("string").alias("event_id"))
    return dedupe.dedupe_stored(_received(spark, sf_dir), seen)


def _first_deliveries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Deliveries and, of these, the ones that were stored: an id is stored by its first batch."""
    received = inputs.received(spark, sf_dir).select("event_id", "batch_id")
    return received, dedupe.dedupe_batch(received, ("batch_id",))


@query
def batch_outcome(spark, sf_dir):
    return dedupe.batch_outcome(*_first_deliveries(spark, sf_dir))


@query
def dedupe_stream(spark, sf_dir):
    root = scratch_path(spark, "dedupe")
    stream = _event_stream(spark, _log_of_deliveries(spark, sf_dir, root))
    kept = live.dedupe_stream(stream).select("event_id", "name")
    live.append_stream(kept, f"{root}/once", f"{root}/checkpoint", ONCE).awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{root}/once")


@query
def dedupe_stream_bounded(spark, sf_dir):
    """A horizon far shorter than the data: copies come after their first delivery has left the state."""
    root = scratch_path(spark, "dedupe")
    records = event_log.read_event_log(spark, _log_of_deliveries(spark, sf_dir, root))
    tables = EventTables(spark, f"{root}/tables").create()
    ingest.ingest_stream_bounded(records, tables, f"{root}/checkpoint", "1 second", trigger=ONCE).awaitTermination()
    return tables.events().select("event_id", "name")


@query
def stats_by_name(spark, sf_dir):
    return dashboard.stats_by_name(_rollup_now(spark, sf_dir), _sketches_now(spark, sf_dir), AS_OF)


@query
def reconcile(spark, sf_dir):
    received = _received(spark, sf_dir)
    return reconcile_names(received, dedupe.first_times(received))


@query
def reconcile_tables(spark, sf_dir):
    """The deliveries against the stored tables, by fingerprints."""
    return reconcile_stored(_received(spark, sf_dir), _stored(spark, sf_dir)[0])


# -- counters -------------------------------------------------------------------------------


@query
def minute_rollup(spark, sf_dir):
    return rollup.minute_rollup(dedupe.first_times(_received(spark, sf_dir)))


@query
def merge_rollups(spark, sf_dir):
    events = inputs.events(spark, sf_dir)
    with_user = rollup.minute_rollup(uniques.filter_has_user(events))
    return rollup.merge_rollups(rollup.minute_rollup(events), with_user)


@query
def count_today(spark, sf_dir):
    return rollup.count_today(_rollup_now(spark, sf_dir), NAME, AS_OF)


@query
def totals_today(spark, sf_dir):
    return rollup.totals_today(_rollup_now(spark, sf_dir), AS_OF)


@query
def grand_total_today(spark, sf_dir):
    return rollup.grand_total_today(_rollup_now(spark, sf_dir), AS_OF)


def _totals(spark, sf_dir) -> DataFrame:
    counters = rollup.minute_rollup(inputs.events(spark, sf_dir))
    return counters.groupBy("name").agg(F.sum("n").alias("count"))


@query
def top_events(spark, sf_dir):
    return rollup.top_events(_totals(spark, sf_dir))


@query
def share_of_max(spark, sf_dir):
    return series.share_of_max(rollup.top_events(_totals(spark, sf_dir)))


@query
def minute_series(spark, sf_dir):
    return rollup.minute_series(_rollup_now(spark, sf_dir), AS_OF)


@query
def dense_series(spark, sf_dir):
    return series.dense_series(_rollup_now(spark, sf_dir), AS_OF)


@query
def share_of_peak(spark, sf_dir):
    return series.share_of_peak(series.dense_series(_rollup_now(spark, sf_dir), AS_OF))


@query
def dashboard_stats(spark, sf_dir):
    return dashboard.dashboard_stats(_rollup_now(spark, sf_dir), _sketches_now(spark, sf_dir), AS_OF)


# -- unique users ---------------------------------------------------------------------------


@query
def uniques_daily(spark, sf_dir):
    return uniques.estimate(uniques.uniques_daily(_received(spark, sf_dir)))


# Up to so many users a sketch still lists what it saw, merged or not, and its estimate is the number itself.
LISTED_USERS = 1_000


def _checked(estimates: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count): estimates of merged sketches after an exact check.

    An estimate of up to LISTED_USERS users stays as it is. Beyond, the true number stands for one that is within
    5 % of it, which is what sketches promise; any other stays and shows, as does a key that one side lacks.
    """
    users = uniques.filter_has_user(events).groupBy(*keys).agg(F.count_distinct("distinct_id").alias("_exact"))
    near = F.abs(F.col("count") - F.col("_exact")) * 20 <= F.col("_exact")
    count = F.when((F.col("_exact") > LISTED_USERS) & near, F.col("_exact")).otherwise(F.col("count"))
    return users.join(estimates, keys, "full").select(*keys, count.alias("count"))


@query
def merge_sketches(spark, sf_dir):
    """Users of all names together, a day, from merged sketches."""
    received = _received(spark, sf_dir)
    merged = uniques.merge_sketches(uniques.uniques_daily(received), ["day"])
    return _checked(uniques.estimate(merged), received.withColumn("day", to_day("ts")), ["day"])


@query
def uniques_today(spark, sf_dir):
    return uniques.uniques_today(_sketches_now(spark, sf_dir), NAME, AS_OF)


@query
def uniques_today_all(spark, sf_dir):
    return uniques.uniques_today_all(_sketches_now(spark, sf_dir), AS_OF)


@query
def uniques_range(spark, sf_dir):
    """A week of users from the tree of stored sketches."""
    tables, _ = _stored(spark, sf_dir)
    merged = uniques.merge_sketches(tables.snapshot().sketches_range(*RANGE), ["name"])
    week = _received(spark, sf_dir).filter(to_day("ts").between(*map(F.lit, RANGE)))
    return _checked(uniques.estimate(merged), week, ["name"])


@query
def exact_uniques(spark, sf_dir):
    return uniques.exact_uniques(_received(spark, sf_dir))


@query
def unique_accuracy(spark, sf_dir):
    report = uniques.unique_accuracy(_received(spark, sf_dir))
    return report.select("name", "day", "exact", (F.col("error_pct") <= 5).alias("within_5pct"))


# -- portable sketches ----------------------------------------------------------------------


@query
def portable_hash(spark, sf_dir):
    return inputs.events(spark, sf_dir).select("event_id", hash_of(F.col("distinct_id")).alias("hash"))


@query
def portable_registers(spark, sf_dir):
    return portable.portable_registers(_received(spark, sf_dir))


@query
def portable_merge(spark, sf_dir):
    return portable.portable_merge(portable.portable_registers(_received(spark, sf_dir)))


@query
def portable_estimate(spark, sf_dir):
    return portable.portable_estimate(portable.portable_registers(_received(spark, sf_dir)))


@query
def portable_uniques_range(spark, sf_dir):
    registers = portable.portable_registers(_received(spark, sf_dir))
    return portable.portable_uniques_range(registers, *RANGE)


@query
def export_portable_sketches(spark, sf_dir):
    sketches = portable.export_portable_sketches(portable.portable_registers(_received(spark, sf_dir)))
    return sketches.select("name", "day", F.md5(F.hex("sketch").cast("binary")).alias("digest"))


@query
def import_portable_sketches(spark, sf_dir):
    """Exported buffers read back; those of one name were cut short and must be set aside."""
    exported = portable.export_portable_sketches(portable.portable_registers(_received(spark, sf_dir)))
    cut = F.when(F.col("name") == "error", F.substring("sketch", 1, 100)).otherwise(F.col("sketch"))
    registers, rejected = portable.import_portable_sketches(exported.withColumn("sketch", cut))
    read = registers.groupBy("name", "day").agg(F.count("*").alias("registers"), F.sum("rank").alias("rank_sum"))
    zero = F.lit(0).cast("long")
    return read.unionAll(rejected.select("name", "day", zero.alias("registers"), zero.alias("rank_sum")))


# -- streaming ------------------------------------------------------------------------------


@query
def ingest_stream(spark, sf_dir):
    root = scratch_path(spark, "ingest")
    log = _log_of_deliveries(spark, sf_dir, root)
    tables = EventTables(spark, f"{root}/tables").create()
    records = event_log.read_event_log(spark, log)
    ingest.ingest_stream(records, tables, f"{root}/checkpoint", trigger=ONCE).awaitTermination()
    return compact_rollup(tables.minute_deltas())


@query
def ingest_stream_with_state(spark, sf_dir):
    """As above with known ids in state, then the daily users of the stored events."""
    root = scratch_path(spark, "ingest")
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    tables = EventTables(spark, f"{root}/tables").create()
    records = event_log.read_event_log(spark, log)
    started = ingest.ingest_stream_with_state(
        records, tables, f"{root}/checkpoint", trigger=ONCE, portable=True
    )
    started.awaitTermination()
    counted = tables.minute_deltas().groupBy("name", "day").agg(F.sum("n").alias("n"))
    users = portable.portable_estimate(portable.portable_merge(tables.register_deltas(), ["name", "day"]))
    return counted.join(users, ["name", "day"])


@query
def live_rollup(spark, sf_dir):
    root = scratch_path(spark, "live")
    log = EventLog("json", f"{root}/log", max_files_per_batch=1)
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    event_log.write_event_log(inputs.events(spark, sf_dir), log)
    stream = _event_stream(spark, log)
    ingest.live_rollup(stream, f"{root}/live", f"{root}/checkpoint", ONCE).awaitTermination()
    return ingest.read_live_rollup(spark, f"{root}/live")


# -- quotas and health ----------------------------------------------------------------------


@query
def fixed_window_quota(spark, sf_dir):
    judged = quota.fixed_window_quota(inputs.requests(spark, sf_dir), WINDOW_LIMIT)
    return judged.select("request_id", "client", "allowed")


@query
def token_bucket_quota(spark, sf_dir):
    judged = quota.token_bucket_quota(inputs.requests(spark, sf_dir), BUCKET_RATE, BUCKET_BURST)
    return judged.select("request_id", "client", "allowed")


def _health(spark, sf_dir) -> DataFrame:
    outcome = dedupe.batch_outcome(*_first_deliveries(spark, sf_dir))
    return inputs.batch_health(outcome, inputs.received(spark, sf_dir))


@query
def flush_health(spark, sf_dir):
    return health.flush_health(_health(spark, sf_dir))


def _histogram(spark, sf_dir) -> DataFrame:
    latencies = inputs.latencies(spark, sf_dir)
    return health.exp_histogram(latencies, "took_seconds", health.INGEST_SECONDS_BUCKETS, ["name"])


@query
def exp_histogram(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query
def batch_size_histogram(spark, sf_dir):
    """Batches by size, in the bounds that flushes are reported in."""
    return health.exp_histogram(_health(spark, sf_dir), "batch_size", health.BATCH_SIZE_BUCKETS)


@query
def flush_time_quantiles(spark, sf_dir):
    """p50 and p99 of flush times from their histogram, by name."""
    histogram = health.exp_histogram(
        inputs.latencies(spark, sf_dir), "took_seconds", health.FLUSH_SECONDS_BUCKETS, ["name"]
    )
    return health.histogram_quantile(histogram, 0.5, ["name"]).unionAll(health.histogram_quantile(histogram, 0.99, ["name"]))


@query
def histogram_quantile(spark, sf_dir):
    return health.histogram_quantile(_histogram(spark, sf_dir), 0.99, ["name"])


@query
def event_rates(spark, sf_dir):
    """Deliveries accepted per minute, and what the flushes of each minute did with them."""
    accepted = _received(spark, sf_dir).select("ts", F.lit("accepted").alias("outcome"))
    return health.event_rates(accepted).unionAll(health.flush_rates(_health(spark, sf_dir)))


@query
def rejected_rate_by_reason(spark, sf_dir):
    judged = validate.with_reason(_parsed(spark, sf_dir)).filter(F.col("reason").isNotNull())
    return health.rejected_rate_by_reason(judged.select(F.col("timestamp").alias("ts"), "reason"))


@query
def latency_percentiles(spark, sf_dir):
    return health.latency_percentiles(inputs.latencies(spark, sf_dir))
