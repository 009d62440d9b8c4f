"""Whole views put together from the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutemill.functions.timing import day_start, series_start
from minutemill.operators.rollup import since, top_events, totals_today
from minutemill.operators.uniques import uniques_today_all


def stats_by_name(rollup: DataFrame, sketches: DataFrame, as_of: datetime | str) -> DataFrame:
    """(name, count, unique_users) of the listed names; null where no user was seen today.

    The list has at most 20 names, a fixed bound, so it is broadcast to leave only their sketches
    to merge.
    """
    totals = totals_today(rollup, as_of)
    listed = sketches.join(F.broadcast(totals.select("name")), "name", "left_semi")
    uniques = uniques_today_all(listed, as_of).withColumnRenamed("count", "unique_users")
    return totals.join(uniques, "name", "left")


def dashboard_stats(
    rollup: DataFrame, sketches: DataFrame, as_of: datetime | str, minutes: float = 15
) -> DataFrame:
    """Today's totals, today's uniques and the recent series in long form.

    Columns (section, name, minute, count) with section one of total, unique, series. Totals and series
    come from one sum per (name, minute): the windows are applied to the newest minute of a group, which
    is not known before the groups are, so both ask for the same groups and Spark makes them once.
    """
    today, recent = day_start(as_of), series_start(as_of, minutes)
    groups = since(rollup, min(today, recent)).groupBy("name", "minute")
    counted = groups.agg(F.sum("n").alias("count"), F.max("minute").alias("_newest"))
    of_today = counted.filter(F.col("_newest") >= F.lit(today)).groupBy("name").agg(F.sum("count").alias("count"))
    no_minute = F.lit(None).cast("timestamp").alias("minute")
    totals = top_events(of_today).select(F.lit("total").alias("section"), "name", no_minute, "count")
    uniques = uniques_today_all(sketches, as_of).select(
        F.lit("unique").alias("section"), "name", no_minute, "count"
    )
    series = counted.filter(F.col("_newest") >= F.lit(recent)).select(
        F.lit("series").alias("section"), "name", "minute", "count"
    )
    return totals.unionAll(uniques).unionAll(series)
