"""Unique users from mergeable sketches.

Sketches are Spark's own (Apache DataSketches HLL, 2^14 buckets): a few hundred bytes to 16 KB per
(name, day), built with map-side partial aggregation and merged without looking at users again.
Below about 1,500 users a sketch still lists what it saw and the estimate is the exact number.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutemill.functions.timing import day_of, to_day

LG_BUCKETS = 14  # all sketches must agree on it to be merged


def filter_has_user(events: DataFrame) -> DataFrame:
    """Only events with a user attached: they alone make sketch rows."""
    return events.filter(F.col("distinct_id") != "")


def _with_day(events: DataFrame) -> DataFrame:
    return events if "day" in events.columns else events.withColumn("day", to_day("ts"))


def uniques_daily(events: DataFrame) -> DataFrame:
    """(name, day, sketch) over received events. A repeated delivery never changes a sketch."""
    users = _with_day(filter_has_user(events))
    return users.groupBy("name", "day").agg(F.hll_sketch_agg("distinct_id", LG_BUCKETS).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ("name", "day")) -> DataFrame:
    """Union of all sketches with the same keys."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketches: DataFrame, alias: str = "count") -> DataFrame:
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.hll_sketch_estimate("sketch").alias(alias))


def _on_day(sketches: DataFrame, as_of: datetime | str) -> DataFrame:
    return sketches.filter(F.col("day") == F.lit(day_of(as_of)))


def uniques_today(sketches: DataFrame, name: str, as_of: datetime | str) -> DataFrame:
    """(event, unique_users_today): always one row, 0 for a name without users today."""
    today = _on_day(sketches, as_of).filter(F.col("name") == F.lit(name))
    merged = today.agg(F.hll_union_agg("sketch").alias("_s"))
    return merged.select(
        F.lit(name).alias("event"),
        F.coalesce(F.hll_sketch_estimate("_s"), F.lit(0).cast("long")).alias("unique_users_today"),
    )


def uniques_today_all(sketches: DataFrame, as_of: datetime | str) -> DataFrame:
    """(name, count) for every name with a user today; no list limit."""
    return estimate(merge_sketches(_on_day(sketches, as_of), ["name"]))


def uniques_range(sketches: DataFrame, first: date, last: date) -> DataFrame:
    """(name, count) of distinct users over the days first..last, from daily sketches only."""
    days = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return estimate(merge_sketches(days, ["name"]))


def exact_uniques(events: DataFrame) -> DataFrame:
    """(name, day, exact): the true number of distinct users."""
    users = _with_day(filter_has_user(events))
    return users.groupBy("name", "day").agg(F.count_distinct("distinct_id").alias("exact"))


def unique_accuracy(events: DataFrame) -> DataFrame:
    """(name, day, estimate, exact, error_pct).

    Users are made distinct once, spread over (name, day, user); both numbers come from those rows.
    """
    users = _with_day(filter_has_user(events)).select("name", "day", "distinct_id").distinct()
    both = users.groupBy("name", "day").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("distinct_id", LG_BUCKETS)).alias("estimate"),
        F.count("*").alias("exact"),
    )
    return both.withColumn("error_pct", F.abs(F.col("estimate") - F.col("exact")) / F.col("exact") * 100)
