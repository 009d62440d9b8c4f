import pytest
from pyspark.sql import functions as F

from minutemill.functions.properties import property_of
from minutemill.operators.validate import reject_counts, validate_events, with_reason
from minutemill.schema import PUBLISH_BATCH
from minutemill.sources.json_lines import parse_event_json
from minutemill.sources.publish_batches import explode_event_batches, reject_report, zip_event_arrays
from tests.conftest import at, rows_of


def parse(spark, *lines):
    return parse_event_json(spark.createDataFrame([(v,) for v in lines], "value string"))


def reason_of(spark, line):
    return with_reason(parse(spark, line)).first()["reason"]


def test_accepted_line(spark):
    row = parse(spark, '{"event_id":"e1","name":"buy_click","distinct_id":"u1"}').first()
    assert (row.malformed, row.event_id, row.name, row.distinct_id) == (False, "e1", "buy_click", "u1")
    assert row.properties is None


CASES = [
    ("not json", "invalid JSON body"),
    ("", "invalid JSON body"),
    ("   ", "invalid JSON body"),
    ("[1]", "invalid JSON body"),
    ("5", "invalid JSON body"),
    ('"text"', "invalid JSON body"),
    ('{"event_id":"e","name":', "invalid JSON body"),
    ('{"event_id":5,"name":"x"}', "invalid JSON body"),
    ('{"event_id":"e","name":true}', "invalid JSON body"),
    ('{"event_id":"e","name":"n","distinct_id":4}', "invalid JSON body"),
    ('{"event_id":"e","name":"n","properties":[1]}', "invalid JSON body"),
    ('{"event_id":"e","name":"n","properties":"{}"}', "invalid JSON body"),
    ("null", "event_id is required"),
    ('{"name":"x"}', "event_id is required"),
    ('{"event_id":null,"name":"x"}', "event_id is required"),
    ("{}", "event_id is required"),
    ('{"event_id":"e1"}', "name is required"),
    ('{"event_id":"e1","name":""}', "name is required"),
    ('{"event_id":" ","name":" "}', None),
    ('{"event_id":"e","name":"n","properties":null}', None),
    ('{"event_id":"e","name":"n"} trailing', None),
    ('{"event_id":"e","name":"n","properties":{"a":1,"a":2}}', None),
]


def test_reasons(spark):
    judged = with_reason(parse(spark, *[line for line, _ in CASES]))
    got = {r.value: r.reason for r in judged.select("value", "reason").collect()}
    assert got == dict(CASES)


def test_size_cap_counts_bytes(spark):
    body = '{"event_id":"e","name":"%s"}'
    fits = body % ("x" * ((1 << 20) - len(body) + 2))
    assert len(fits) == 1 << 20
    wide = body % ("é" * ((1 << 19)))
    assert reason_of(spark, fits) is None
    assert reason_of(spark, fits.replace("xx", "xxx", 1)) == "invalid JSON body"
    assert reason_of(spark, wide) == "invalid JSON body"


def test_properties_are_canonical_and_keep_integers(spark):
    row = parse(spark, '{"event_id":"e","name":"n","properties":{"b":9007199254740993, "a":{"z":null}}}').first()
    assert row.properties == '{"a":{"z":null},"b":9007199254740993}'


def test_last_repeated_property_wins(spark):
    df = parse(spark, '{"event_id":"e","name":"n","properties":{"a":1,"a":2}}')
    assert df.select(property_of(F.col("properties"), "$.a", "int").alias("a")).first().a == 2


def test_control_and_non_ascii_characters_are_kept(spark):
    row = parse(spark, '{"event_id":"e\\u0000","name":"é"}').first()
    assert (row.event_id, row.name) == ("e\x00", "é")


def test_other_columns_travel_along(spark):
    raw = spark.createDataFrame([(7, "not json")], "offset long, value string")
    assert parse_event_json(raw).first().offset == 7


def test_reject_counts(spark):
    rejected = validate_events(parse(spark, "x", '{"name":"n"}', '{"event_id":"e"}'))[1].select("reason")
    limited = spark.createDataFrame([("rate_limited",)] * 2, "reason string")
    assert rows_of(reject_counts(rejected.unionAll(limited))) == [("invalid", 3), ("rate_limited", 2)]


@pytest.fixture
def calls(spark):
    rows = [
        ("ok", [("e1", "buy_click", "u1", {"src": "sdk"}), ("e2", "page_view", "u2", None)]),
        ("mixed", [("", "x", "u", None), ("e2", "", "u", None), ("e3", "buy_click", None, None)]),
        ("empty", []),
        ("none", None),
    ]
    return spark.createDataFrame(rows, PUBLISH_BATCH)


def test_reject_report(calls):
    got = {r.batch_id: (r.accepted, [(x["index"], x.reason) for x in r.rejected]) for r in reject_report(calls).collect()}
    assert got == {
        "ok": (2, []),
        "mixed": (1, [(0, "event_id is required"), (1, "name is required")]),
        "empty": (0, []),
        "none": (0, []),
    }


def test_report_needs_no_shuffle(calls):
    assert "Exchange" not in reject_report(calls)._jdf.queryExecution().executedPlan().toString()


def test_exploded_calls_agree_with_the_report(calls):
    judged = with_reason(explode_event_batches(calls))
    assert rows_of(judged.filter("reason IS NOT NULL"), "batch_id", "index") == [("mixed", 0), ("mixed", 1)]
    kept = judged.filter("batch_id = 'ok'")
    assert rows_of(kept, "index", "event_id", "properties") == [(0, "e1", '{"src":"sdk"}'), (1, "e2", "{}")]


def test_parallel_arrays(spark):
    row = (["a", "b"], ["x", "y"], ["", "u"], ["{}", "{}"], [at("2024-01-01 00:00:00")] * 2)
    df = spark.createDataFrame(
        [row],
        "event_id array<string>, name array<string>, distinct_id array<string>, properties array<string>, "
        "ts array<timestamp>",
    )
    assert rows_of(zip_event_arrays(df), "event_id", "name", "distinct_id") == [("a", "x", ""), ("b", "y", "u")]
