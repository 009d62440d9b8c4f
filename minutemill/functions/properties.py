"""Free-form event properties, kept as canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_properties(properties: Column) -> Column:
    """A string map as a JSON object; an absent map is an empty object."""
    return F.coalesce(F.to_json(properties), F.lit("{}"))


def default_properties(events: DataFrame) -> DataFrame:
    """An absent `properties` becomes an empty object."""
    return events.withColumn("properties", F.coalesce("properties", F.lit("{}")))


def property_of(properties: Column, path: str, as_type: str = "string") -> Column:
    """One property by JSON path, null where absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(properties), path, as_type)
