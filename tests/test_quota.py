import random
from datetime import timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from minutemill.functions.client import client_key
from minutemill.operators.quota import fixed_window_quota, token_bucket_quota
from tests.conftest import at

START = at("2024-01-01 00:00:00")


def log(spark, rows):
    data = [(i, c, START + timedelta(microseconds=us)) for i, (c, us) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, client string, ts timestamp")


def verdicts(df):
    return {r.request_id: r.allowed for r in df.select("request_id", "allowed").collect()}


def bucket_by_hand(rows, rate, burst):
    token, state, out = Fraction(1), {}, {}
    for i, (client, us) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        tokens, last = state.get(client, (Fraction(burst), us))
        tokens = min(Fraction(burst), tokens + Fraction(us - last, 1_000_000) * rate)
        out[i] = tokens >= token
        state[client] = (tokens - token if out[i] else tokens, us)
    return out


def window_by_hand(rows, limit, micros):
    used, out = {}, {}
    for i, (client, us) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        key = (client, us // micros)
        used[key] = used.get(key, 0) + 1
        out[i] = used[key] <= limit
    return out


def test_burst_then_deny(spark):
    assert verdicts(token_bucket_quota(log(spark, [("a", 0)] * 4), 1, 3)) == {0: True, 1: True, 2: True, 3: False}


def test_keys_are_independent(spark):
    rows = [("a", 0), ("a", 0), ("b", 0)]
    assert verdicts(token_bucket_quota(log(spark, rows), 1, 1)) == {0: True, 1: False, 2: True}


def test_denied_request_takes_no_token(spark):
    rows = [("a", 0), ("a", 500_000), ("a", 1_000_000)]
    assert verdicts(token_bucket_quota(log(spark, rows), 1, 1)) == {0: True, 1: False, 2: True}


def test_default_burst_is_twice_the_rate(spark):
    assert sum(verdicts(token_bucket_quota(log(spark, [("a", 0)] * 9), 3)).values()) == 6


def traffic(seed, clients, span, n, step):
    rng = random.Random(seed)
    return [(rng.choice(clients), rng.randrange(span // step) * step) for _ in range(n)]


@pytest.mark.parametrize(
    "rate,burst,rows",
    [
        (3, 5, traffic(1, ["hot"] * 6 + list("abc"), 60_000_000, 900, 1_000)),
        (Fraction(1, 2), 2, traffic(2, ["hot", "b"], 90_000_000, 500, 10_000)),
        (7, 7, traffic(3, ["x"], 30_000_000, 700, 100_000)),
        # quiet, then saturated, then quiet: the phase moves in the middle
        (
            2,
            4,
            [("x", i * 700_003) for i in range(40)]
            + [("x", 28_000_000 + i * 50_021) for i in range(500)]
            + [("x", 55_000_000 + i * 900_007) for i in range(20)],
        ),
    ],
)
def test_chunked_bucket_equals_the_chain(spark, rate, burst, rows):
    expected = bucket_by_hand(rows, Fraction(rate), burst)
    whole = verdicts(token_bucket_quota(log(spark, rows), rate, burst))
    cut = verdicts(token_bucket_quota(log(spark, rows), rate, burst, hot_instants=50, chunk_seconds=4))
    assert whole == expected
    assert cut == expected


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_fixed_window_equals_counting(spark, limit):
    rows = traffic(5, ["hot"] * 5 + ["a"], 6_000_000, 600, 100_000)
    assert verdicts(fixed_window_quota(log(spark, rows), limit)) == window_by_hand(rows, limit, 1_000_000)
    assert verdicts(fixed_window_quota(log(spark, rows), limit, 3)) == window_by_hand(rows, limit, 3_000_000)


def test_fixed_window_limits_rows_before_the_shuffle(spark):
    df = fixed_window_quota(log(spark, [("a", 0), ("a", 1)]), 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_client_key(spark):
    cases = [
        (None, "203.0.113.9:51234", "203.0.113.9"),
        ("team-42", "203.0.113.9:51234", "team-42"),
        ("", "[2001:db8::1]:80", "2001:db8::1"),
        (None, "no-port", "no-port"),
        (None, "2001:db8::1", "2001:db8::1"),
        (None, None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "k string, a string, expected string")
    assert df.filter(client_key(F.col("k"), F.col("a")) != F.col("expected")).isEmpty()
