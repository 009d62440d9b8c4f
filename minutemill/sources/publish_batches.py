"""Publish calls that carry many events each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutemill.functions.properties import map_properties


def explode_event_batches(batches: DataFrame) -> DataFrame:
    """One row per event with its zero-based index in the call."""
    rows = batches.select(
        *[c for c in batches.columns if c != "events"], F.posexplode("events").alias("index", "_e")
    )
    return rows.select(
        *[c for c in rows.columns if c != "_e"],
        F.coalesce("_e.event_id", F.lit("")).alias("event_id"),
        F.coalesce("_e.name", F.lit("")).alias("name"),
        F.coalesce("_e.distinct_id", F.lit("")).alias("distinct_id"),
        map_properties(F.col("_e.properties")).alias("properties"),
    )


def zip_event_arrays(batches: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows from parallel arrays, one array per event column."""
    names = columns or ["event_id", "name", "distinct_id", "properties", "ts"]
    kept = [c for c in batches.columns if c not in names]
    zipped = batches.select(*kept, F.explode(F.arrays_zip(*names)).alias("_e"))
    return zipped.select(*kept, *[F.col(f"_e.{n}").alias(n) for n in names])


def _reason(event: Column) -> Column:
    return F.when(F.coalesce(event["event_id"], F.lit("")) == "", F.lit("event_id is required")).when(
        F.coalesce(event["name"], F.lit("")) == "", F.lit("name is required")
    )


def reject_report(batches: DataFrame) -> DataFrame:
    """Per call: how many events were accepted, and (index, reason) of each rejected one.

    A call already sits in one row, so its report is made there, without exploding or shuffling.
    """
    verdicts = F.transform(
        F.coalesce("events", F.array()),
        lambda e, i: F.struct(i.cast("int").alias("index"), _reason(e).alias("reason")),
    )
    return batches.select("batch_id", verdicts.alias("_v")).select(
        "batch_id",
        F.size(F.filter("_v", lambda v: v["reason"].isNull())).alias("accepted"),
        F.filter("_v", lambda v: v["reason"].isNotNull()).alias("rejected"),
    )
