"""Pipeline health: flush totals, histograms, quantiles, rates and latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutemill.functions.timing import to_minute
from minutemill.operators.validate import reject_class


def exp_buckets(start: float, factor: float, count: int) -> list[float]:
    """Upper bounds growing by `factor`."""
    bounds = [start]
    while len(bounds) < count:
        bounds.append(bounds[-1] * factor)
    return bounds


# The bounds the pipeline reports batch sizes and durations in.
BATCH_SIZE_BUCKETS = exp_buckets(1, 2, 12)
FLUSH_SECONDS_BUCKETS = exp_buckets(0.0005, 2, 14)
INGEST_SECONDS_BUCKETS = exp_buckets(0.00005, 2, 14)


def flush_health(batch_health: DataFrame) -> DataFrame:
    """Totals over finished batches; a batch with an error counts as dropped and nothing else."""
    failed = F.col("error").isNotNull()

    def total(column: str, only) -> Column:
        return F.coalesce(F.sum(F.when(only, F.col(column))), F.lit(0).cast("long"))

    return batch_health.agg(
        F.count("*").alias("flushes"),
        F.coalesce(F.sum("batch_size"), F.lit(0).cast("long")).alias("events"),
        total("inserted", ~failed).alias("inserted"),
        total("duplicates", ~failed).alias("duplicates"),
        total("batch_size", failed).alias("dropped"),
    )


def exp_histogram(
    values: DataFrame, column: str, bounds: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, le, count): cumulative counts per upper bound, the last bound being infinity.

    All buckets come from one pass: a row adds to its counters in place, nothing is exploded
    before the aggregation.
    """
    counters = [F.count_if(F.col(column) <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = values.groupBy(*keys).agg(*counters, F.count(column).alias("_all"))
    buckets = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count")))
    return wide.select(*keys, F.explode(F.array(*buckets)).alias("_b")).select(*keys, "_b.le", "_b.count")


def histogram_quantile(histogram: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, quantile, value): linear interpolation inside the bucket that holds rank q * total.

    The lowest bucket starts at 0; a rank beyond the largest finite bound gives that bound. The
    windows run over the buckets of one histogram, a handful of rows.
    """
    by_bound = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    finite = F.col("le") != float("inf")
    placed = (
        histogram.withColumn("_from", F.coalesce(F.lag("le").over(by_bound), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("count").over(by_bound), F.lit(0)))
        .withColumn("_rank", F.lit(float(q)) * F.max("count").over(whole))
        .withColumn("_largest", F.max(F.when(finite, F.col("le"))).over(whole))
    )
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * F.try_divide(
        F.col("_rank") - F.col("_below"), F.col("count") - F.col("_below")
    )
    value = F.when(~finite, F.col("_largest")).when(F.col("le") <= 0, F.col("le")).otherwise(inside)
    holding = placed.filter(F.col("count") >= F.col("_rank"))
    first = F.min(F.struct("le", value.alias("value"))).alias("_v")
    return holding.groupBy(*keys).agg(first).select(
        *keys, F.lit(float(q)).alias("quantile"), F.col("_v.value").alias("value")
    )


def event_rates(outcomes: DataFrame) -> DataFrame:
    """(minute, outcome, per_second) from rows (ts, outcome)."""
    counts = outcomes.groupBy(to_minute("ts").alias("minute"), "outcome").agg(F.count("*").alias("_n"))
    return counts.select("minute", "outcome", (F.col("_n") / 60).alias("per_second"))


def flush_rates(batch_health: DataFrame) -> DataFrame:
    """(minute, outcome, per_second) of flushed batches, by the minute a batch was finished in.

    Outcomes are inserted, duplicate and dropped; a batch with an error was dropped as a whole.
    """
    failed = F.col("error").isNotNull()

    def part(label: str, rows: Column) -> Column:
        return F.struct(F.lit(label).alias("outcome"), rows.alias("rows"))

    stored = [part("inserted", F.col("inserted")), part("duplicate", F.col("duplicates"))]
    parts = F.when(failed, F.array(part("dropped", F.col("batch_size")))).otherwise(F.array(*stored))
    rows = batch_health.select(to_minute("ts").alias("minute"), F.explode(parts).alias("_p"))
    sums = rows.groupBy("minute", "_p.outcome").agg(F.sum("_p.rows").alias("_n"))
    return sums.select("minute", "outcome", (F.col("_n") / 60).alias("per_second"))


def rejected_rate_by_reason(rejected: DataFrame) -> DataFrame:
    """(minute, reason, per_second) from rows (ts, reason); reasons are counted by their class."""
    return event_rates(rejected.select("ts", reject_class(F.col("reason")).alias("outcome"))).withColumnRenamed(
        "outcome", "reason"
    )


def latency_percentiles(
    latencies: DataFrame,
    column: str = "took_seconds",
    probs: Sequence[float] = (0.5, 0.95, 0.99, 1.0),
    small: int = 1_000_000,
    accuracy: int = 10_000,
) -> DataFrame:
    """(prob, value): the element at place floor(prob * (n - 1)) of the sorted values, exactly.

    Sorting everything for four numbers is avoided. An approximate quantile sketch brackets each
    place, rows outside the brackets are filtered at the scan and only counted, and the bracket is
    narrowed again until at most `small` rows are left in it. Those are counted per value and
    ranked. The driver holds a few numbers per place.
    """
    values = latencies.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    margins = [3 / accuracy] * len(probs)

    def around(i: int, at: float, only: Column) -> Column:
        edges = [F.lit(max(0.0, at - margins[i])), F.lit(min(1.0, at + margins[i]))]
        return F.percentile_approx(F.when(only, F.col("v")), F.array(*edges), F.lit(accuracy))

    start = values.agg(
        F.count("*").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        *[around(i, p, F.lit(True)).alias(f"b{i}") for i, p in enumerate(probs)],
    ).first()
    if not start["n"]:
        return values.select(F.lit(0.0).alias("prob"), F.col("v").alias("value"))
    n = start["n"]
    places = [int(p * (n - 1)) for p in probs]
    wide = [(start["least"], start["most"])] * len(probs)
    brackets = [tuple(start[f"b{i}"]) for i in range(len(probs))] if n > small else list(wide)

    def within(bracket):
        return F.col("v").between(F.lit(bracket[0]), F.lit(bracket[1]))

    while True:
        counts = values.agg(
            *[F.count_if(F.col("v") < F.lit(b[0])).alias(f"below{i}") for i, b in enumerate(brackets)],
            *[F.count_if(within(b)).alias(f"inside{i}") for i, b in enumerate(brackets)],
        ).first()
        below = [counts[f"below{i}"] for i in range(len(probs))]
        inside = [counts[f"inside{i}"] for i in range(len(probs))]
        missed = [i for i, at in enumerate(places) if not below[i] <= at < below[i] + inside[i]]
        if missed:  # go back to the last bracket that held the place and narrow it less
            for i in missed:
                brackets[i] = wide[i]
                margins[i] *= 4
            continue
        open_ = [i for i, b in enumerate(brackets) if inside[i] > small and b[0] < b[1]]
        if not open_:
            break
        narrowed = values.filter(_any([within(brackets[i]) for i in open_])).agg(
            *[
                around(i, (places[i] - below[i]) / inside[i], within(brackets[i])).alias(f"b{i}")
                for i in open_
            ]
        ).first()
        changed = False
        for i in open_:
            tighter = tuple(narrowed[f"b{i}"])
            changed |= tighter != brackets[i]
            wide[i], brackets[i] = brackets[i], tighter
        if not changed:
            break
    tags = F.array(
        *[
            F.when(within(b), F.struct(F.lit(float(p)).alias("prob"), F.lit(at - lower).alias("place")))
            for p, b, at, lower in zip(probs, brackets, places, below)
        ]
    )
    kept = values.filter(_any([within(b) for b in brackets]))
    tagged = kept.select("v", F.explode(F.array_compact(tags)).alias("_t"))
    counted = tagged.groupBy("_t.prob", "_t.place", "v").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy("prob").orderBy("v"))
    reached = counted.withColumn("_upto", running).filter(F.col("_upto") > F.col("place"))
    return reached.groupBy("prob").agg(F.min("v").alias("value"))


def _any(conditions: list) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
