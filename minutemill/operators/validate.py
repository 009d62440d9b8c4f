"""Which events are accepted, which are rejected and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What clients are told.
NO_ID, NO_NAME, BAD_BODY = "event_id is required", "name is required", "invalid JSON body"


def reject_reason(events: DataFrame) -> Column:
    """First failing check, or null. Empty means exactly ''; a missing user is fine."""
    reason = F.when(F.coalesce("event_id", F.lit("")) == "", F.lit(NO_ID)).when(
        F.coalesce("name", F.lit("")) == "", F.lit(NO_NAME)
    )
    if "malformed" in events.columns:
        reason = F.when(F.col("malformed"), F.lit(BAD_BODY)).otherwise(reason)
    return reason


def with_reason(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", reject_reason(events))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected side keeps a `reason`."""
    judged = with_reason(events)
    accepted = judged.filter(F.col("reason").isNull()).drop("reason", "malformed")
    return accepted, judged.filter(F.col("reason").isNotNull())


def reject_class(reason: Column) -> Column:
    """The class that rejections are counted by: a failed check is 'invalid', any other reason is its own."""
    return F.when(reason.isin(NO_ID, NO_NAME, BAD_BODY), F.lit("invalid")).otherwise(reason)


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Number of rejections per class."""
    return (
        rejected.select(reject_class(F.col("reason")).alias("reason"))
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )
