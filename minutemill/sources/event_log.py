"""The durable event log: key = event name, value = JSON of the event including its `ts`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from minutemill.schema import EVENT_COLUMNS
from minutemill.sources.json_lines import parse_event_json

_RECORD = "key string, value string, timestamp timestamp"


@dataclass(frozen=True)
class EventLog:
    """Where the log is and how much of it one micro-batch may take.

    `format` is "kafka" (needs the Kafka connector on the cluster) or "json" for files of records
    with the same three columns. Batches of files end at `max_bytes_per_batch`, where it is given, or else at
    `max_files_per_batch`; a file is never cut, so one beyond the bound is a batch by itself. With `min_records_per_batch` a Kafka batch waits until it is that
    large or `max_delay` has passed, whichever comes first.
    """

    format: str
    location: str
    topic: str = "events"
    max_records_per_batch: int = 1_000_000
    max_files_per_batch: int = 1_000
    max_bytes_per_batch: int | None = None
    min_records_per_batch: int | None = None
    max_delay: str = "10s"
    options: dict[str, str] = field(default_factory=dict)

    def read_options(self) -> dict[str, str]:
        if self.format == "kafka":
            waiting = {}
            if self.min_records_per_batch is not None:
                waiting["minOffsetsPerTrigger"] = str(self.min_records_per_batch)
                waiting["maxTriggerDelay"] = self.max_delay
            return {
                "kafka.bootstrap.servers": self.location,
                "subscribe": self.topic,
                "startingOffsets": "earliest",
                "maxOffsetsPerTrigger": str(self.max_records_per_batch),
                # A gap in the log is an error, not something to skip quietly.
                "failOnDataLoss": "true",
                **waiting,
                **self.options,
            }
        if self.max_bytes_per_batch is not None:
            return {"maxBytesPerTrigger": str(self.max_bytes_per_batch), **self.options}
        return {"maxFilesPerTrigger": str(self.max_files_per_batch), **self.options}


def encode_records(events: DataFrame) -> DataFrame:
    """Events as log records. Equal names share a key, hence a partition of the log."""
    value = F.to_json(
        F.struct(
            "event_id",
            "name",
            "distinct_id",
            F.try_parse_json(F.coalesce("properties", F.lit("{}"))).alias("properties"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        )
    )
    return events.select(F.col("name").alias("key"), value.alias("value"), F.col("ts").alias("timestamp"))


def write_event_log(events: DataFrame, log: EventLog) -> None:
    """Append events to the log. Tasks write what they hold; nothing is shuffled by name."""
    records = encode_records(events)
    if log.format == "kafka":
        writer = records.drop("timestamp").write.format("kafka").option("kafka.bootstrap.servers", log.location)
        writer.option("topic", log.topic).options(**log.options).save()
    else:
        records.write.mode("append").json(log.location)


def write_event_log_stream(
    events: DataFrame, log: EventLog, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Forward a stream of events to the log."""
    records = encode_records(events)
    if log.format == "kafka":
        writer = records.drop("timestamp").writeStream.format("kafka")
        writer = writer.option("kafka.bootstrap.servers", log.location).option("topic", log.topic)
    else:
        writer = records.writeStream.format("json").option("path", log.location)
    writer = writer.options(**log.options).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_event_log(spark: SparkSession, log: EventLog, streaming: bool = True) -> DataFrame:
    """Raw records of the log, in bounded micro-batches when streaming."""
    reader = (spark.readStream if streaming else spark.read).format(log.format)
    if log.format == "kafka":
        options = log.read_options()
        if not streaming:
            for limit in ("maxOffsetsPerTrigger", "minOffsetsPerTrigger", "maxTriggerDelay"):
                options.pop(limit, None)
        records = reader.options(**options).load()
    else:
        records = reader.schema(_RECORD).options(**log.read_options()).load(log.location)
    return records.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp"
    )


def stamp_ingest_time(events: DataFrame, arrival: str = "timestamp") -> DataFrame:
    """Give events without a `ts` the arrival time recorded by the log.

    A `ts` in the payload wins, so a redelivered event keeps its minute. The wall clock is never
    read here: a replayed batch must come out the same.
    """
    return events.withColumn("ts", F.coalesce("ts", arrival))


def decode_records(records: DataFrame) -> DataFrame:
    """Records to events with a `malformed` flag; bad records stay as rows and stop nothing."""
    return stamp_ingest_time(parse_event_json(records, max_bytes=None, with_ts=True)).select("value", "malformed", *EVENT_COLUMNS)
