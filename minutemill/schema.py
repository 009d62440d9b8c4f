"""Schemas of the inputs and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One event. `properties` is JSON text; '' is a legal distinct_id and means "no user attached".
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("distinct_id", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()

# One publish call holding many events; properties are string-valued on this path.
PUBLISH_BATCH = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("event_id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("distinct_id", T.StringType()),
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

# Stored tables. The partition column comes last.
_DAY = T.StructField("day", T.DateType())

EVENTS_TABLE = T.StructType([*EVENT.fields, T.StructField("batch_id", T.StringType()), _DAY])
MINUTE_DELTAS_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("minute", T.TimestampType()),
        T.StructField("n", T.LongType()),
        _DAY,
    ]
)
SKETCH_DELTAS_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sketch", T.BinaryType()),
        _DAY,
    ]
)
# Portable sketches as rows: at most 16,384 registers per (name, day) and batch.
REGISTER_DELTAS_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("register", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        _DAY,
    ]
)
# Sketches of 2^level days, under the first of these days.
SKETCH_NODES_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("sketch", T.BinaryType()),
        _DAY,
    ]
)
# Ids of all stored events, sorted by hash inside a bucket.
EVENT_IDS_TABLE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("id_hash", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
QUARANTINE_TABLE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        _DAY,
    ]
)
# One row for every batch and every failed attempt.
BATCH_HEALTH_TABLE = T.StructType(
    [
        T.StructField("batch_size", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("duplicates", T.LongType()),
        T.StructField("took_seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
    ]
)
# As it is stored; rows since the last checkpoint are in the manifest.
STORED_HEALTH_TABLE = T.StructType(
    [
        *BATCH_HEALTH_TABLE.fields,
        T.StructField("parts", T.LongType()),
        T.StructField("received_print", T.ArrayType(T.LongType())),
        T.StructField("stored_print", T.ArrayType(T.LongType())),
        T.StructField("generation", T.LongType()),
        _DAY,
    ]
)
