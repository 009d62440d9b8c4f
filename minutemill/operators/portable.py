"""Portable sketches: HyperLogLog kept as rows, with a fixed byte layout for exchange.

A sketch is a set of (register, rank) rows per key, at most 16,384 of them. Building it is a `max`
per register and merging is the same `max` over fewer keys, so both are ordinary aggregations with
map-side combine. The byte form is version, precision, then one byte per register.
"""

from collections.abc import Iterator, Sequence
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutemill.functions.hashing import (
    PRECISION,
    REGISTERS,
    portable_hash,
    rank_of,
    register_and_rank,
    register_of,
)
from minutemill.functions.timing import day_of, to_day
from minutemill.operators.uniques import filter_has_user

# Fixed values of the byte layout.
FORMAT_VERSION = 1
BUFFER_BYTES = 2 + REGISTERS


def portable_registers(events: DataFrame, arrow: bool = True) -> DataFrame:
    """(name, day, register, rank) over received events with a user."""
    users = filter_has_user(events)
    day = F.col("day") if "day" in events.columns else to_day("ts")
    if arrow:
        packed = users.select("name", day.alias("day"), register_and_rank(F.col("distinct_id")).alias("_p"))
        ranked = packed.select(
            "name",
            "day",
            F.shiftright("_p", 6).alias("register"),
            F.col("_p").bitwiseAND(F.lit(63)).alias("rank"),
        )
    else:
        hashed = users.select("name", day.alias("day"), portable_hash(F.col("distinct_id")).alias("_h"))
        ranked = hashed.select(
            "name", "day", register_of(F.col("_h")).alias("register"), rank_of(F.col("_h")).alias("rank")
        )
    return portable_merge(ranked, ["name", "day"])


def portable_merge(registers: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Union of sketches: the larger rank per register, over the given keys."""
    return registers.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def portable_estimate(registers: DataFrame, keys: Sequence[str] = ("name", "day")) -> DataFrame:
    """(keys, estimate). Registers without a row count as rank 0.

    Sums of powers of two are exact, so the order of addition does not matter.
    """
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = registers.groupBy(*keys).agg(
        F.count("*").alias("_set"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_filled")
    )
    zeros = F.lit(REGISTERS) - F.col("_set")
    raw = F.lit(alpha * m * m) / (F.col("_filled") + zeros)
    small = F.lit(m) * F.ln(F.lit(m) / zeros)
    value = F.when((raw <= 2.5 * m) & (zeros > 0), small).otherwise(raw)
    return sums.select(*keys, F.floor(value + 0.5).cast("long").alias("estimate"))


def portable_uniques_today(registers: DataFrame, as_of: datetime | str) -> DataFrame:
    """(name, count) for every name with a user on the UTC day of `as_of`."""
    return portable_uniques_range(registers, day_of(as_of), day_of(as_of))


def portable_uniques_range(registers: DataFrame, first: date, last: date) -> DataFrame:
    """(name, count) of distinct users over the days first..last."""
    days = registers.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return portable_estimate(portable_merge(days), ["name"]).withColumnRenamed("estimate", "count")


def valid_buffer(sketch: str = "sketch"):
    header = bytes([FORMAT_VERSION, PRECISION])
    return F.coalesce(
        (F.octet_length(sketch) == BUFFER_BYTES) & (F.substring(sketch, 1, 2) == F.lit(header)),
        F.lit(False),
    )


def import_portable_sketches(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buffers in `sketch` to (register rows, rejected rows); other columns are the keys."""
    sound = valid_buffer()
    keys = [c for c in table.columns if c != "sketch"]
    schema = T.StructType(
        [table.schema[c] for c in keys]
        + [T.StructField("register", T.IntegerType()), T.StructField("rank", T.IntegerType())]
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_table = batch.select(keys)
            for row, buffer in enumerate(batch.column("sketch")):
                ranks = np.frombuffer(buffer.as_buffer(), np.uint8)[2:]
                filled = np.flatnonzero(ranks)
                repeated = key_table.take(pa.array(np.full(len(filled), row)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *repeated.columns,
                        pa.array(filled.astype(np.int32)),
                        pa.array(ranks[filled].astype(np.int32)),
                    ],
                    names=[*keys, "register", "rank"],
                )

    registers = table.filter(sound).select(*keys, "sketch").mapInArrow(unpack, schema)
    return registers, table.filter(~sound)


def export_portable_sketches(registers: DataFrame, keys: Sequence[str] = ("name", "day")) -> DataFrame:
    """(keys, sketch) in the byte layout.

    A key has one row per register and so at most 16,384 of them to collect. The buffer is written
    from one filled register to the next with the zeros between them.
    """
    filled = F.array_sort(F.collect_list(F.struct("register", "rank")))
    grouped = portable_merge(registers, keys).groupBy(*keys).agg(filled.alias("_r"))

    def piece(entry, i):
        before = F.coalesce(F.get("_r", i - 1)["register"], F.lit(-1))
        return F.concat(F.repeat(F.lit("00"), entry["register"] - before - 1), F.lpad(F.hex(entry["rank"]), 2, "0"))

    tail = F.repeat(F.lit("00"), F.lit(REGISTERS - 1) - F.element_at("_r", -1)["register"])
    header = F.lit(f"{FORMAT_VERSION:02X}{PRECISION:02X}")
    return grouped.select(
        *keys, F.unhex(F.concat(header, F.array_join(F.transform("_r", piece), ""), tail)).alias("sketch")
    )
