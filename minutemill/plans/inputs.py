"""The library's inputs made from the `events` table of a data folder.

The table has unique ids, no empty users and no bad lines. Those are derived here, for a share of
the rows picked by id arithmetic, and the oracle SQL derives the same. Every source row is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The instant that "today" and "the last minutes" refer to.
AS_OF = "2024-01-15 18:30:45"


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _as_events(rows: DataFrame, *extra: str) -> DataFrame:
    user = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("user_"), "user_id"))
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("name"),
        user.alias("distinct_id"),
        F.col("props").alias("properties"),
        F.col("ts").cast("timestamp").alias("ts"),
        *extra,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once; one in seven has no user."""
    return _as_events(source_events(spark, sf_dir))


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with `batch_id`: one event in five comes again 36 hours and one batch later.

    Half of the second copies carry another user. Copies are made row by row from one scan.
    """
    ids = F.col("event_id")
    copies = F.when(ids % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = _as_events(source_events(spark, sf_dir).withColumn("_copy", F.explode(copies)), "_copy")
    number = F.col("event_id").cast("long")
    again = F.col("_copy") == 1
    changed = again & (number % 10 == 0) & (F.col("distinct_id") != "")
    batch = F.floor(number / 1000) + F.col("_copy")
    return rows.select(
        "event_id",
        "name",
        F.when(changed, F.concat("distinct_id", F.lit("_b"))).otherwise(F.col("distinct_id")).alias("distinct_id"),
        "properties",
        F.when(again, F.col("ts") + F.expr("INTERVAL 36 HOURS")).otherwise(F.col("ts")).alias("ts"),
        F.lpad(batch.cast("string"), 12, "0").alias("batch_id"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, value, timestamp, client): JSON envelopes, some broken, one line per event."""
    id_ = F.col("event_id")
    kind = id_ % 11
    quoted = F.concat(F.lit('"'), id_.cast("string"), F.lit('"'))
    name = F.concat(F.lit('"'), "event_type", F.lit('"'))

    def line(id_text, name_text, properties):
        parts = [F.lit('{"event_id":'), id_text, F.lit(',"name":'), name_text]
        user = [F.lit(',"distinct_id":"user_'), F.col("user_id").cast("string"), F.lit('"')]
        return F.concat(*parts, *user, F.lit(',"properties":'), properties, F.lit("}"))

    value = (
        F.when(kind == 0, F.concat(F.lit("not json "), id_.cast("string")))
        .when(kind == 1, line(F.lit('""'), name, F.col("props")))
        .when(kind == 2, line(quoted, F.lit("null"), F.col("props")))
        .when(kind == 3, line(id_.cast("string"), name, F.col("props")))
        .when(kind == 4, line(quoted, name, F.lit("null")))
        .when(kind == 5, line(quoted, name, F.lit("[1]")))
        .when(kind == 6, F.concat(F.lit('{"name":'), name, F.lit("}")))
        .otherwise(line(quoted, name, F.col("props")))
    )
    return source_events(spark, sf_dir).select(
        id_.alias("line_id"),
        value.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("user_"), "user_id").alias("client"),
    )


def publish_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish calls, one per source row, each with the event itself and three more envelopes.

    One envelope has no id, one no name where the id is even, and one repeats the event.
    """
    id_ = F.col("event_id").cast("string")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    properties = F.create_map(F.lit("type"), F.col("event_type"), F.lit("source"), F.lit("sdk"))

    def envelope(event_id, name, props):
        return F.struct(
            event_id.alias("event_id"), name.alias("name"), user.alias("distinct_id"), props.alias("properties")
        )

    name = F.col("event_type")
    half_named = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(name)
    none = F.lit(None).cast("map<string,string>")
    calls = F.array(
        envelope(id_, name, properties),
        envelope(F.lit(""), name, properties),
        envelope(F.concat(id_, F.lit("-x")), half_named, none),
        envelope(id_, name, properties),
    )
    return source_events(spark, sf_dir).select(id_.alias("batch_id"), calls.alias("events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, client, ts): the events as calls of their users, squeezed into ten minutes."""
    second = F.col("event_id") % 600
    return source_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("user_"), "user_id").alias("client"),
        F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("ts"),
    )


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, api_key, remote_addr): keys on some calls, addresses of several shapes."""
    user = F.col("user_id").cast("string")
    port = F.concat(F.lit(":"), (F.lit(1024) + F.col("event_id") % 60_000).cast("string"))
    kind = F.col("event_id") % 5
    return source_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.when(kind == 0, F.concat(F.lit("team-"), user)).when(kind == 1, F.lit("")).alias("api_key"),
        F.when(kind == 2, F.concat(F.lit("[2001:db8::"), user, F.lit("]"), port))
        .when(kind == 3, F.concat(F.lit("host-"), user))
        .when(kind != 4, F.concat(F.lit("10.0.0."), user, port))
        .alias("remote_addr"),
    )


def batch_health(outcome: DataFrame, received: DataFrame) -> DataFrame:
    """Health rows from per-batch outcomes, finished at the batch's last event.

    One batch in four is taken to have failed.
    """
    failed = F.col("batch_id").cast("long") % 4 == 3
    finished = received.groupBy("batch_id").agg(F.max("ts").alias("ts"))
    return outcome.join(finished, "batch_id").select(
        F.col("received").alias("batch_size"),
        "inserted",
        "duplicates",
        F.when(failed, F.lit("timeout")).alias("error"),
        "ts",
        "batch_id",
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, name, took_seconds)."""
    return source_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("name"),
        (F.col("value") / 1000).alias("took_seconds"),
    )
