"""Streaming de-duplication on Spark's own state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from minutemill.session import stream_partitions


def drop_nearby_copies(events: DataFrame) -> DataFrame:
    """Leave out copies of an id within one Arrow batch of a task.

    Streaming de-duplication sends every row to the task that owns its id and has no step before
    that, so a hot id would bring all its copies to one task. Copies mostly travel together; this
    cuts them by the size of an Arrow batch before the shuffle. The rest is left to the state.
    """

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("event_id").dictionary_encode(null_encoding="encode").indices
            _, first = np.unique(codes.to_numpy(zero_copy_only=False), return_index=True)
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))

    return events.mapInArrow(first_of_each, events.schema)


def dedupe_stream(events: DataFrame) -> DataFrame:
    """Each event_id once, for all time. The state holds every id: use the RocksDB provider."""
    return drop_nearby_copies(events).dropDuplicates(["event_id"])


def thin_recent_copies(events: DataFrame, horizon: str) -> DataFrame:
    """Each event_id once within `horizon` of arrival; a copy that comes later than that comes through again.

    Arrival is the time of the micro-batch, which only moves forward: state ends, and no row is ever late
    however old its own time is. Which late copies come through depends on when batches run, so whoever
    counts must still compare with the ids of all history, as `ingest_stream_bounded` does.
    """
    arrived = drop_nearby_copies(events).withColumn("_arrival", F.current_timestamp())
    timed = arrived.withWatermark("_arrival", horizon)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("_arrival")


def append_stream(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream to Parquet files."""
    writer = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
    )
    with stream_partitions(rows.sparkSession):
        return writer.start()
