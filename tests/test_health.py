import math
import random

import pytest
from pyspark.sql import functions as F

from minutemill.operators.health import (
    BATCH_SIZE_BUCKETS,
    FLUSH_SECONDS_BUCKETS,
    INGEST_SECONDS_BUCKETS,
    event_rates,
    exp_histogram,
    flush_health,
    flush_rates,
    histogram_quantile,
    latency_percentiles,
    rejected_rate_by_reason,
)
from minutemill.schema import BATCH_HEALTH_TABLE
from tests.conftest import at, rows_of


def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "took_seconds double")


def test_bucket_bounds():
    assert BATCH_SIZE_BUCKETS[-1] == 2048 and len(BATCH_SIZE_BUCKETS) == 12
    assert FLUSH_SECONDS_BUCKETS[-1] == pytest.approx(4.096)
    assert INGEST_SECONDS_BUCKETS[-1] == pytest.approx(0.4096)


def test_histogram_is_cumulative_with_inclusive_bounds(spark):
    h = exp_histogram(numbers(spark, [0.5, 1, 1.5, 2, 9]), "took_seconds", [1, 2, 4])
    assert rows_of(h) == [(1.0, 2), (2.0, 4), (4.0, 4), (math.inf, 5)]


def test_histogram_quantile(spark):
    h = exp_histogram(numbers(spark, [0.5] * 10 + [1.5] * 10), "took_seconds", [1, 2, 4])
    assert histogram_quantile(h, 0.5).first().value == 1.0
    assert histogram_quantile(h, 0.75).first().value == 1.5
    above = exp_histogram(numbers(spark, [9, 9]), "took_seconds", [1, 2, 4])
    assert histogram_quantile(above, 0.5).first().value == 4.0


@pytest.mark.parametrize("small,accuracy", [(1_000_000, 10_000), (20, 50), (5, 20)])
@pytest.mark.parametrize("shape", ["spread", "ties", "outlier"])
def test_percentiles_are_elements_of_the_sorted_list(spark, small, accuracy, shape):
    rng = random.Random(7)
    values = [rng.random() for _ in range(3_000)]
    if shape == "ties":
        values = [1.0] * 1_500 + values
    if shape == "outlier":
        values.append(1e12)
    probs = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.prob: r.value for r in latency_percentiles(numbers(spark, values), probs=probs, small=small, accuracy=accuracy).collect()}
    ordered = sorted(values)
    assert got == {p: ordered[int(p * (len(values) - 1))] for p in probs}


def test_percentiles_of_little_or_nothing(spark):
    assert rows_of(latency_percentiles(numbers(spark, [3.0]))) == [(p, 3.0) for p in (0.5, 0.95, 0.99, 1.0)]
    assert latency_percentiles(numbers(spark, [])).isEmpty()


def test_flush_health_counts_failed_batches_as_dropped(spark):
    rows = [
        (10, 8, 2, 0.1, None, at("2024-01-01 00:00:00"), "a"),
        (5, 5, 0, 0.1, None, at("2024-01-01 00:00:01"), "b"),
        (7, 0, 7, 0.1, "timeout", at("2024-01-01 00:00:02"), "c"),
    ]
    assert rows_of(flush_health(spark.createDataFrame(rows, BATCH_HEALTH_TABLE))) == [(3, 22, 13, 2, 7)]


def test_flush_rates(spark):
    rows = [
        (60, 30, 30, 0.1, None, at("2024-01-01 00:00:10"), "a"),
        (60, 60, 0, 0.1, None, at("2024-01-01 00:00:50"), "b"),
        (120, 0, 0, 0.1, "timeout", at("2024-01-01 00:00:59"), "c"),
    ]
    rates = flush_rates(spark.createDataFrame(rows, BATCH_HEALTH_TABLE))
    assert rows_of(rates, "outcome", "per_second") == [("dropped", 2.0), ("duplicate", 0.5), ("inserted", 1.5)]


def test_rates(spark):
    df = spark.createDataFrame(
        [(at("2024-01-01 00:00:05"), "accepted")] * 30 + [(at("2024-01-01 00:01:00"), "dropped")] * 6,
        "ts timestamp, outcome string",
    )
    assert rows_of(event_rates(df), "outcome", "per_second") == [("accepted", 0.5), ("dropped", 0.1)]
    by_reason = rejected_rate_by_reason(df.select("ts", F.col("outcome").alias("reason")))
    assert by_reason.columns == ["minute", "reason", "per_second"]
