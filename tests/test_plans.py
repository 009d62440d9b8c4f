"""What the physical plans must look like, so that they hold up on large tables."""

import pytest

from minutemill.operators.dedupe import new_events_only
from minutemill.operators.rollup import count_today, filter_today, minute_rollup, totals_today
from minutemill.operators.uniques import uniques_daily, uniques_range
from minutemill.plans import inputs
from minutemill.session import scratch_path
from minutemill.sources.tables import EventTables
from minutemill.streaming.ingest import ingest_batch
from tests.conftest import SF_DIR


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    made = EventTables(spark, scratch_path(spark, "plans")).create()
    ingest_batch(made, inputs.events(spark, SF_DIR), "b-0")
    return made


def test_name_filter_reaches_the_scan(tables):
    plan = plan_of(tables.events().filter("name = 'click'").select("event_id"))
    assert "EqualTo(name,click)" in plan
    assert "ReadSchema: struct<event_id:string,name:string>" in plan


def test_today_skips_other_days(tables):
    plan = plan_of(filter_today(tables.minute_deltas(), inputs.AS_OF))
    assert "PartitionFilters" in plan and "(day#" in plan.split("PartitionFilters", 1)[1]
    assert "GreaterThanOrEqual(minute" in plan


def test_count_today_reads_counters_not_events(tables):
    plan = plan_of(count_today(tables.minute_deltas(), "click", inputs.AS_OF))
    assert "tables/events" not in plan and "EqualTo(name,click)" in plan


def test_range_of_days_prunes_and_merges_sketches_only(tables):
    from datetime import date

    plan = plan_of(uniques_range(tables.sketch_deltas(), date(2024, 1, 3), date(2024, 1, 5)))
    assert "distinct_id" not in plan and "partial_hll_union_agg" in plan


def test_top_list_does_not_sort_everything(spark):
    plan = plan_of(totals_today(minute_rollup(inputs.events(spark, SF_DIR)), inputs.AS_OF))
    assert "TakeOrderedAndProject" in plan


def test_counters_and_sketches_combine_before_the_shuffle(spark):
    events = inputs.events(spark, SF_DIR)
    assert "partial_count" in plan_of(minute_rollup(events))
    sketches = plan_of(uniques_daily(events))
    assert "partial_hll_sketch_agg" in sketches and sketches.count("Exchange hashpartitioning") == 1


def test_small_batch_is_broadcast_to_history_after_it_was_measured(spark, tables, events_of):
    batch = events_of(("1", "a", "u", "2024-01-02 01:00:00"), ("x", "a", "u", "2024-01-02 01:00:00")).cache()
    batch.count()
    fresh = new_events_only(batch, tables.events())
    plan = plan_of(fresh)
    assert "BroadcastHashJoin [event_id" in plan and "LeftSemi" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert [r.event_id for r in fresh.collect()] == ["x"]
    batch.unpersist()


def test_large_batch_joins_history_by_shuffle(spark, tables):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = inputs.events(spark, SF_DIR)
        fresh = new_events_only(batch, tables.events())
        assert "SortMergeJoin" in plan_of(fresh)
        assert fresh.isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
