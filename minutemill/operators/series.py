"""Gap-free series and the proportions drawn from lists and series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutemill.functions.timing import minute_start, series_start
from minutemill.operators.rollup import filter_last_minutes


def dense_series(rollup: DataFrame, as_of: datetime | str, minutes: int = 15) -> DataFrame:
    """(minute, count) over all names, one row for every minute of the window, zeros included.

    At most minutes + 1 sums leave the aggregation, so the join after it is tiny.
    """
    start, end = F.lit(series_start(as_of, minutes)), F.lit(minute_start(as_of))
    spark = rollup.sparkSession
    spine = spark.range(1).select(
        F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MINUTE"))).alias("minute")
    )
    sums = (
        filter_last_minutes(rollup, as_of, minutes)
        .filter(F.col("minute") <= end)
        .groupBy("minute")
        .agg(F.sum("n").alias("_n"))
    )
    return spine.join(sums, "minute", "left").select(
        "minute", F.coalesce("_n", F.lit(0).cast("long")).alias("count")
    )


def share_of_max(totals: DataFrame) -> DataFrame:
    """Adds `share`: percent of the largest count, at least 2. `totals` is a top list."""
    largest = F.max("count").over(Window.partitionBy())
    scale = F.when(largest == 0, F.lit(1)).otherwise(largest)
    return totals.withColumn("share", F.greatest(F.lit(2.0), 100.0 * F.col("count") / scale))


def share_of_peak(series: DataFrame) -> DataFrame:
    """Adds `share`: percent of the highest minute, at least 1. `series` is a dense window."""
    peak = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return series.withColumn("share", F.greatest(F.lit(1.0), 100.0 * F.col("count") / peak))
