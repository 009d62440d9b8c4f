from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minutemill.functions.hashing import (
    FNV_OFFSET,
    FNV_PRIME,
    MIX_FIRST,
    MIX_SECOND,
    portable_hash,
    rank_of,
    register_and_rank,
    register_of,
)
from minutemill.operators.portable import (
    export_portable_sketches,
    import_portable_sketches,
    portable_estimate,
    portable_merge,
    portable_registers,
)
from minutemill.operators.uniques import (
    estimate,
    exact_uniques,
    merge_sketches,
    unique_accuracy,
    uniques_daily,
    uniques_range,
    uniques_today,
    uniques_today_all,
)
from tests.conftest import at, rows_of

TODAY = "2024-01-02 12:00:00"


def users(spark, first, last, name="a", day="2024-01-02", copies=1):
    ids = spark.range(first, last)
    if copies > 1:
        ids = ids.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("c")
    return ids.select(
        F.lit(name).alias("name"),
        F.concat(F.lit("user_"), "id").alias("distinct_id"),
        F.lit(at(f"{day} 01:00:00")).alias("ts"),
    )


def both_estimates(events):
    builtin = estimate(merge_sketches(uniques_daily(events), ["name"])).first()["count"]
    portable = portable_estimate(portable_merge(portable_registers(events)), ["name"]).first()["estimate"]
    return builtin, portable


@pytest.mark.parametrize("n", [100, 1_000, 10_000, 100_000, 1_000_000])
def test_accuracy(spark, n):
    for value in both_estimates(users(spark, 0, n)):
        assert abs(value - n) / n <= 0.05


def test_repeated_users_do_not_count_again(spark):
    for value in both_estimates(users(spark, 0, 5_000, copies=10)):
        assert abs(value - 5_000) / 5_000 <= 0.05


def test_union_of_overlapping_days(spark):
    events = users(spark, 0, 10_000).unionAll(users(spark, 5_000, 15_000, day="2024-01-03"))
    for value in both_estimates(events):
        assert abs(value - 15_000) / 15_000 <= 0.05
    ranged = uniques_range(uniques_daily(events), date(2024, 1, 2), date(2024, 1, 3)).first()["count"]
    assert abs(ranged - 15_000) / 15_000 <= 0.05


def test_today_for_known_unknown_and_anonymous_names(events_of):
    events = events_of(
        ("1", "a", "u1", "2024-01-02 01:00:00"),
        ("2", "a", "u1", "2024-01-02 02:00:00"),
        ("3", "a", "u2", "2024-01-01 02:00:00"),
        ("4", "b", "", "2024-01-02 02:00:00"),
    )
    sketches = uniques_daily(events)
    assert rows_of(uniques_today(sketches, "a", TODAY)) == [("a", 1)]
    assert rows_of(uniques_today(sketches, "never", TODAY)) == [("never", 0)]
    assert rows_of(uniques_today_all(sketches, TODAY)) == [("a", 1)]
    assert rows_of(sketches, "name", "day") == [("a", date(2024, 1, 1)), ("a", date(2024, 1, 2))]


def test_received_copies_count_as_users(events_of):
    events = events_of(("1", "a", "u1", "2024-01-02 01:00:00"), ("1", "a", "u2", "2024-01-02 01:00:01"))
    assert rows_of(estimate(uniques_daily(events)), "count") == [(2,)]


def test_accuracy_report(spark):
    row = unique_accuracy(users(spark, 0, 20_000, copies=2)).first()
    assert row.exact == 20_000 and row.error_pct <= 5
    assert row.error_pct == pytest.approx(abs(row.estimate - 20_000) / 200)
    assert exact_uniques(users(spark, 0, 500, copies=3)).first().exact == 500


def hash_by_hand(data: bytes) -> int:
    mask, h = (1 << 64) - 1, FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & mask
    h ^= h >> 30
    h = h * MIX_FIRST & mask
    h ^= h >> 27
    h = h * MIX_SECOND & mask
    return h ^ h >> 31


def check_hashes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", portable_hash(F.col("t")).alias("h"), register_and_rank(F.col("t")).alias("p")
    )
    for r in df.select("*", register_of(F.col("h")).alias("reg"), rank_of(F.col("h")).alias("rank")).collect():
        expected = hash_by_hand(r.t.encode())
        rest = (expected << 14) & ((1 << 64) - 1)
        rank = min(51, 65 - rest.bit_length())
        assert r.h % (1 << 64) == expected
        assert (r.reg, r["rank"]) == (expected >> 50, rank)
        assert (r.p >> 6, r.p & 63) == (expected >> 50, rank)


def test_hash_of_chosen_texts(spark):
    check_hashes(spark, ["", "a", "é", "日本語", "\x00", "user_42", "x" * 1_000, "ÿ" * 33])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=30))
def test_hash_of_any_text(spark, texts):
    check_hashes(spark, texts)


def test_null_users_have_no_register(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    assert [r[0] is None for r in df.select(register_and_rank(F.col("t"))).collect()] == [False, True, False]


def test_both_forms_build_the_same_registers(spark):
    events = users(spark, 0, 3_000)
    assert rows_of(portable_registers(events, arrow=True)) == rows_of(portable_registers(events, arrow=False))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 200), min_size=1, max_size=50), st.lists(st.integers(0, 200), min_size=1, max_size=50))
def test_merge_is_commutative_and_idempotent(spark, left, right):
    def registers(ids):
        rows = [("a", f"u{i}", at(TODAY)) for i in ids]
        return portable_registers(spark.createDataFrame(rows, "name string, distinct_id string, ts timestamp"))

    x, y = registers(left).cache(), registers(right).cache()
    keys = ["name", "day"]
    ab, ba = portable_merge(x.unionAll(y), keys), portable_merge(y.unionAll(x), keys)
    assert rows_of(ab) == rows_of(ba) == rows_of(portable_merge(ab.unionAll(x), keys)) == rows_of(registers(left + right))


def test_buffers_survive_a_round_trip(spark):
    registers = portable_registers(users(spark, 0, 20_000))
    buffers = export_portable_sketches(registers)
    buffer = buffers.first().sketch
    assert len(buffer) == 16_386 and buffer[:2] == b"\x01\x0e"
    back, rejected = import_portable_sketches(buffers)
    assert rows_of(back) == rows_of(registers)
    assert rejected.isEmpty()
    assert rows_of(portable_estimate(back)) == rows_of(portable_estimate(registers))


def test_bad_buffers_are_set_aside(spark):
    good = bytes([1, 14]) + bytes(16_384)
    bad = [None, b"", b"abc", bytes(100), bytes([2, 14]) + bytes(16_384), bytes([1, 13]) + bytes(16_384), good + b"\x00"]
    rows = [(str(i), bytearray(b) if b is not None else None) for i, b in enumerate([*bad, good])]
    registers, rejected = import_portable_sketches(spark.createDataFrame(rows, "name string, sketch binary"))
    assert rejected.count() == len(bad)
    assert registers.isEmpty()  # the good one is an empty sketch
