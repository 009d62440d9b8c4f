from datetime import date

import pytest
from pyspark.sql import functions as F

from minutemill.functions.timing import known_at
from minutemill.operators.dedupe import batch_outcome, dedupe_batch, dedupe_stored, first_times, new_events_only
from minutemill.operators.reconcile import reconcile
from minutemill.operators.rollup import (
    count_today,
    filter_last_minutes,
    grand_total_today,
    merge_rollups,
    minute_rollup,
    minute_series,
    totals_today,
)
from minutemill.operators.series import dense_series, share_of_max, share_of_peak
from minutemill.operators.uniques import exact_uniques, uniques_daily
from minutemill.plans.dashboard import dashboard_stats, stats_by_name
from tests.conftest import at, rows_of

NOON = "2024-01-02 12:00:30"


def counters(spark, *rows):
    return spark.createDataFrame([(n, at(m), c) for n, m, c in rows], "name string, minute timestamp, n long")


def test_first_copy_wins_under_any_input_order(events_of):
    a = ("e1", "buy", "u1", "2024-01-01 00:00:01")
    b = ("e1", "buy", "u2", "2024-01-01 00:00:02")
    c = ("e1", "buy", "u0", "2024-01-01 00:00:02")
    for rows in ((a, b, c), (c, b, a), (b, a, c)):
        assert rows_of(dedupe_batch(events_of(*rows)), "event_id", "distinct_id") == [("e1", "u1")]
    assert rows_of(dedupe_batch(events_of(b, c)), "distinct_id") == [("u0",)]
    assert rows_of(first_times(events_of(c, b, a))) == [("e1", "buy", "2024-01-01 00:00:01")]


def test_a_hot_id_is_combined_before_the_shuffle(events_of):
    plan = dedupe_batch(events_of(("e", "n", "u", NOON)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_counting_does_not_shuffle_users_and_properties(events_of):
    df = minute_rollup(first_times(events_of(("e", "n", "u", NOON))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number()" in plan and "distinct_id" not in plan.split("LogicalRDD")[0]


def test_stored_ids_are_skipped(events_of, spark):
    seen = spark.createDataFrame([("e1",), ("e9",)], "event_id string")
    batch = events_of(("e1", "n", "u", NOON), ("e2", "n", "u", NOON), ("e2", "n", "u", NOON))
    assert rows_of(new_events_only(batch, seen), "event_id") == [("e2",), ("e2",)]
    assert rows_of(dedupe_stored(batch, seen), "event_id") == [("e2",)]


def test_batch_outcome(spark):
    received = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "batch_id string")
    inserted = spark.createDataFrame([("a",)] * 3, "batch_id string")
    assert rows_of(batch_outcome(received, inserted)) == [("a", 3, 3, 0), ("b", 2, 0, 2)]


def test_reconcile_finds_losses_and_ignores_copies(spark):
    accepted = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "x"), ("3", "y")], "event_id string, name string")
    stored = spark.createDataFrame([("1", "x"), ("3", "y"), ("4", "z")], "event_id string, name string")
    assert rows_of(reconcile(accepted, stored)) == [("x", 2, 1, 1), ("y", 1, 1, 0), ("z", 0, 1, -1)]


def test_duplicate_after_midnight(events_of):
    received = events_of(("e1", "buy", "u1", "2024-01-01 23:59:59"), ("e1", "buy", "u1", "2024-01-02 00:00:01"))
    counted = minute_rollup(dedupe_batch(received))
    assert rows_of(counted) == [("buy", "2024-01-01 23:59:00", 1)]
    assert rows_of(exact_uniques(received), "day") == [(date(2024, 1, 1),), (date(2024, 1, 2),)]


def test_merge_adds_up(spark):
    one = counters(spark, ("a", "2024-01-01 00:00:00", 2))
    two = counters(spark, ("a", "2024-01-01 00:00:00", 3), ("b", "2024-01-01 00:00:00", 1))
    assert rows_of(merge_rollups(one, two), "name", "n") == [("a", 5), ("b", 1)]


def test_count_today_is_zero_for_unknown_names_and_ignores_yesterday(spark):
    rollup = counters(spark, ("a", "2024-01-01 23:59:00", 5), ("a", "2024-01-02 00:00:00", 2), ("a", "2024-01-02 09:00:00", 3))
    assert rows_of(count_today(rollup, "a", NOON)) == [("a", 5)]
    assert rows_of(count_today(rollup, "never", NOON)) == [("never", 0)]


def test_totals_list_twenty_names_with_ties_by_name(spark):
    rollup = counters(spark, *[(f"n{i:02}", "2024-01-02 01:00:00", 1) for i in range(21)])
    top = totals_today(rollup, NOON).collect()
    assert [r.name for r in top] == [f"n{i:02}" for i in range(20)]
    assert grand_total_today(rollup, NOON).first().total == 20
    assert grand_total_today(rollup, NOON, all_names=True).first().total == 21
    assert grand_total_today(rollup.limit(0), NOON).first().total == 0


def test_window_edges_and_sixteen_buckets(spark):
    rollup = counters(
        spark, ("a", "2024-01-02 11:44:00", 1), ("a", "2024-01-02 11:45:00", 2), ("b", "2024-01-02 12:00:00", 4)
    )
    series = minute_series(rollup, NOON).collect()
    assert [(r.name, r["count"]) for r in series] == [("a", 2), ("b", 4)]
    dense = [r["count"] for r in dense_series(rollup, NOON).orderBy("minute").collect()]
    assert dense == [2] + [0] * 14 + [4]
    assert filter_last_minutes(rollup, NOON, 15.9).count() == 2
    shares = [r.share for r in share_of_peak(dense_series(rollup, NOON)).orderBy("minute").collect()]
    assert shares == [50.0] + [1.0] * 14 + [100.0]


def test_shares_of_nothing(spark):
    empty = counters(spark, ("a", "2024-01-01 00:00:00", 1))
    assert {r.share for r in share_of_peak(dense_series(empty, NOON)).collect()} == {1.0}
    zero = spark.createDataFrame([("a", 0)], "name string, count long")
    assert share_of_max(zero).first().share == 2.0
    few = spark.createDataFrame([("a", 1000), ("b", 1)], "name string, count long")
    assert rows_of(share_of_max(few), "name", "share") == [("a", 100.0), ("b", 2.0)]


def test_past_instants_see_only_what_had_arrived(events_of):
    events = events_of(("e1", "a", "u", "2024-01-02 10:00:00"), ("e2", "a", "u", "2024-01-02 13:00:00"))
    assert rows_of(count_today(minute_rollup(known_at(events, NOON)), "a", NOON)) == [("a", 1)]
    assert rows_of(count_today(minute_rollup(events), "a", NOON)) == [("a", 2)]  # lower bound only


def test_stats_show_null_where_no_user_was_seen(events_of):
    events = events_of(
        ("e1", "a", "u1", "2024-01-02 10:00:00"),
        ("e2", "a", "u2", "2024-01-02 10:00:00"),
        ("e3", "b", "", "2024-01-02 11:50:00"),
    )
    rollup, sketches = minute_rollup(events), uniques_daily(events)
    assert rows_of(stats_by_name(rollup, sketches, NOON)) == [("a", 2, 2), ("b", 1, None)]
    assert rows_of(dashboard_stats(rollup, sketches, NOON)) == [
        ("series", "b", "2024-01-02 11:50:00", 1),
        ("total", "a", None, 2),
        ("total", "b", None, 1),
        ("unique", "a", None, 2),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_literals_do_not_depend_on_the_session_zone(spark, zone):
    rollup = counters(spark, ("a", "2024-01-02 00:00:00", 2), ("a", "2024-01-01 23:59:00", 9)).cache()
    rollup.count()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert count_today(rollup, "a", NOON).first().count_today == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        rollup.unpersist()
    assert rollup.filter(F.col("n") == 9).count() == 1
