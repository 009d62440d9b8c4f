"""Each event_id counts once, however often it is delivered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_COPY_ORDER = ("ts", "name", "distinct_id", "properties")


def dedupe_batch(events: DataFrame, order: Sequence[str] = FIRST_COPY_ORDER) -> DataFrame:
    """The first copy of each event_id under a total order, so a replay picks the same copy.

    Spark limits each task to one row per id before the shuffle ("window group limit"), so an id
    that was delivered a billion times does not meet in one place.
    """
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    return events.withColumn("_copy", first).filter(F.col("_copy") == 1).drop("_copy")


def first_times(events: DataFrame) -> DataFrame:
    """(event_id, name, ts) of the first copies: all that counters need.

    Time and name lead the order of copies, so the other columns cannot change these and stay out
    of the shuffle.
    """
    return dedupe_batch(events.select("event_id", "name", "ts"), ("ts", "name"))


def new_events_only(batch: DataFrame, seen: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows of `batch` whose event_id is not in `seen`.

    A left-anti join cannot broadcast its left side, so the history is first cut down to the ids
    the batch holds (`ids`, by default taken from the batch). Spark broadcasts them there when
    their measured size allows it (a materialised cache or the runtime statistics tell it), and
    then the history is neither shuffled nor sorted; a large batch makes both sides shuffle by
    event_id, once.
    """
    wanted = (batch if ids is None else ids).select("event_id").distinct()
    already = seen.select("event_id").join(wanted, "event_id", "left_semi")
    return batch.join(already, "event_id", "left_anti")


def new_in_stream(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """`new_events_only` for a micro-batch, whose rows fit in the memory of its tasks.

    History goes once past hash tables of the batch and is not sorted. The batch is used in one place: Spark
    does not find a second use of a micro-batch in its cache and would run the stream's state again for it.
    """
    known = seen.select(F.col("event_id").alias("_known"))
    judged = batch.hint("shuffle_hash").join(known, F.col("event_id") == F.col("_known"), "left_outer")
    return judged.filter(F.col("_known").isNull()).select(*batch.columns)


def dedupe_stored(batch: DataFrame, seen: DataFrame, micro: bool = False) -> DataFrame:
    """First copies in the batch that history does not hold yet; `micro` says that it is a stream's micro-batch."""
    firsts = dedupe_batch(batch)
    return new_in_stream(firsts, seen) if micro else new_events_only(firsts, seen, ids=batch)


def batch_outcome(received: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per batch_id: rows received, rows inserted, duplicates. One aggregation, no join."""
    tagged = received.select("batch_id", F.lit(0).alias("_new")).unionAll(
        inserted.select("batch_id", F.lit(1).alias("_new"))
    )
    counts = tagged.groupBy("batch_id").agg(
        F.count_if(F.col("_new") == 0).alias("received"), F.count_if(F.col("_new") == 1).alias("inserted")
    )
    return counts.withColumn("duplicates", F.col("received") - F.col("inserted"))
