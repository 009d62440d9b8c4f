"""JSON event envelopes, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINE_BYTES = 1 << 20

# Fields are read as VARIANT so that a number or an object in a text field is seen as such instead
# of being turned into text.
_ENVELOPE = "event_id variant, name variant, distinct_id variant, properties variant, _unread string"
_RECORD = _ENVELOPE.replace("_unread", "ts timestamp, _unread")


_TEXT_FIELDS = ("event_id", "name", "distinct_id")


def _text(field: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col(f"_j.{field}"), "$", "string"), F.lit(""))


def _not_text(field: str) -> Column:
    """Neither absent, nor JSON null, nor a JSON string."""
    kind = F.schema_of_variant(F.col(f"_j.{field}"))
    return F.coalesce((kind != "STRING") & (kind != "VOID"), F.lit(False))


def parse_event_json(raw: DataFrame, max_bytes: int | None = MAX_LINE_BYTES, with_ts: bool = False) -> DataFrame:
    """Lines in `value` to typed events with a `malformed` flag; other columns are kept.

    A line is malformed when it is not a JSON object, is longer than `max_bytes`, or holds a text
    field that is not text or properties that are not an object. Malformed rows keep their `value`
    and carry no event fields. Requests have no time of their own: a `ts` in one is ignored like any unknown
    field. Log records (`with_ts`) have, and no limit of size need hold for them (`max_bytes` None).
    """
    parsed = raw.withColumn(
        "_j", F.from_json("value", _RECORD if with_ts else _ENVELOPE, {"columnNameOfCorruptRecord": "_unread"})
    )
    # The canonical text of the properties is made once, in a projection of its own.
    texts = parsed.select(*raw.columns, "_j", F.to_json(F.col("_j.properties")).alias("_properties"))
    blank = F.trim("value") == "null"  # decodes to an event without an id
    unreadable = (F.col("_j").isNull() | F.col("_j._unread").isNotNull()) & ~blank
    properties = F.coalesce("_properties", F.lit("null"))
    malformed = (
        F.col("value").isNull()
        | (F.lit(False) if max_bytes is None else F.octet_length("value") > max_bytes)
        | unreadable
        | _not_text("event_id")
        | _not_text("name")
        | _not_text("distinct_id")
        | ((properties != "null") & ~properties.startswith("{"))
    )
    flagged = texts.withColumn("malformed", F.coalesce(malformed, F.lit(True)))
    sound = ~F.col("malformed")
    kept = [c for c in raw.columns if c not in (*_TEXT_FIELDS, "properties", "ts")]
    return flagged.select(
        *kept,
        "malformed",
        *[F.when(sound, _text(field)).alias(field) for field in _TEXT_FIELDS],
        F.when(sound & (F.col("_properties") != "null"), F.col("_properties")).alias("properties"),
        (F.when(sound, F.col("_j.ts")) if with_ts else F.lit(None).cast("timestamp")).alias("ts"),
    )
