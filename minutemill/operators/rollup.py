"""Per-minute counters and the questions answered from them.

A rollup has the columns (name, minute, n) and may carry `day`. Rows with the same key add up, so
a table of deltas is as good as a table with one row per key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutemill.functions.timing import day_start, series_start, to_minute

TOP_NAMES = 20


def minute_rollup(events: DataFrame) -> DataFrame:
    """Events per (name, minute). Give it inserted events, not received ones."""
    return events.groupBy("name", to_minute("ts").alias("minute")).agg(F.count("*").alias("n"))


def merge_rollups(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Add rollups up to one row per (name, minute)."""
    parts = first.select("name", "minute", "n")
    for rollup in more:
        parts = parts.unionAll(rollup.select("name", "minute", "n"))
    return parts.groupBy("name", "minute").agg(F.sum("n").alias("n"))


def since(rollup: DataFrame, start: datetime) -> DataFrame:
    """Lower bound only. The bound on `day` lets partitions be skipped; `minute` alone would not."""
    kept = rollup.filter(F.col("minute") >= F.lit(start))
    if "day" in rollup.columns:
        kept = kept.filter(F.col("day") >= F.lit(start.date()))
    return kept


def filter_name(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("name") == F.lit(name))


def filter_today(rollup: DataFrame, as_of: datetime | str) -> DataFrame:
    """Minutes since the start of the UTC day of `as_of`."""
    return since(rollup, day_start(as_of))


def filter_last_minutes(rollup: DataFrame, as_of: datetime | str, minutes: float = 15) -> DataFrame:
    """The current minute and the `minutes` before it."""
    return since(rollup, series_start(as_of, minutes))


def count_today(rollup: DataFrame, name: str, as_of: datetime | str) -> DataFrame:
    """(event, count_today): always one row, 0 for a name never seen."""
    today = filter_today(filter_name(rollup, name), as_of)
    return today.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("count_today")).select(
        F.lit(name).alias("event"), "count_today"
    )


def _totals(rollup: DataFrame, as_of: datetime | str) -> DataFrame:
    return filter_today(rollup, as_of).groupBy("name").agg(F.sum("n").alias("count"))


def top_events(totals: DataFrame, limit: int = TOP_NAMES) -> DataFrame:
    """Largest counts first, ties by name."""
    return totals.orderBy(F.desc("count"), F.asc("name")).limit(limit)


def totals_today(rollup: DataFrame, as_of: datetime | str, limit: int = TOP_NAMES) -> DataFrame:
    """(name, count) of the names with the most events today."""
    return top_events(_totals(rollup, as_of), limit)


def grand_total_today(rollup: DataFrame, as_of: datetime | str, all_names: bool = False) -> DataFrame:
    """Sum of the listed totals; `all_names=True` also counts the names below the list."""
    listed = _totals(rollup, as_of) if all_names else totals_today(rollup, as_of)
    return listed.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("total"))


def _by_minute(rollup: DataFrame, as_of: datetime | str, minutes: float) -> DataFrame:
    recent = filter_last_minutes(rollup, as_of, minutes)
    return recent.groupBy("name", "minute").agg(F.sum("n").alias("count"))


def minute_series(rollup: DataFrame, as_of: datetime | str, minutes: float = 15) -> DataFrame:
    """(name, minute, count) of the last minutes, oldest first; quiet minutes are absent."""
    return _by_minute(rollup, as_of, minutes).orderBy("minute", "name")
