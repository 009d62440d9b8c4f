"""Nothing lost, nothing counted twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fingerprint has this many buckets of ids with four numbers each: rows, and sums of three pieces of the
# ids' hashes. Pieces are short, so that sums over 2^42 rows stay whole numbers of 64 bits.
PRINT_BUCKETS, PRINT_NUMBERS, _PIECE_BITS = 16, 4, 21


def fingerprint(event_id: str = "event_id") -> Column:
    """Aggregate: PRINT_BUCKETS * PRINT_NUMBERS whole numbers that tell multisets of ids apart. Fingerprints of
    parts add up to that of the whole, in any order."""
    id_hash, mask = f"xxhash64({event_id})", (1 << _PIECE_BITS) - 1
    pieces = ["1L", *[f"shiftrightunsigned({id_hash}, {_PIECE_BITS * i}) & {mask}L" for i in range(PRINT_NUMBERS - 1)]]
    sums = [
        f"coalesce(sum(if(pmod({id_hash}, {PRINT_BUCKETS}) = {b}, {piece}, 0L)), 0L)" for b in range(PRINT_BUCKETS) for piece in pieces
    ]
    return F.expr(f"array({', '.join(sums)})")


def print_bucket(event_id: str = "event_id") -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(PRINT_BUCKETS))


def differing_buckets(first: Sequence[int], second: Sequence[int]) -> list[int]:
    return sorted({i // PRINT_NUMBERS for i, (a, b) in enumerate(zip(first, second, strict=True)) if a != b})


def reconcile(accepted: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, accepted, stored, difference) on distinct ids; every difference must be 0.

    The accepted log may hold copies, also under another name. Each accepted id counts once, under the
    name of its stored copy, else under that of its first copy (by time where there is one, then name).
    """

    def side(rows: DataFrame, is_stored: bool) -> DataFrame:
        time = F.col("ts") if "ts" in rows.columns else F.lit(None)
        return rows.select("event_id", "name", time.cast("timestamp").alias("ts"), F.lit(is_stored).alias("_stored"))

    first = F.struct(~F.col("_stored"), "ts", "name")
    ids = (
        side(accepted, False)
        .unionAll(side(stored, True))
        .groupBy("event_id")
        .agg(
            F.min_by("name", first).alias("name"),
            F.bool_or(~F.col("_stored")).cast("long").alias("accepted"),
            F.bool_or("_stored").cast("long").alias("stored"),
        )
    )
    counts = ids.groupBy("name").agg(F.sum("accepted").alias("accepted"), F.sum("stored").alias("stored"))
    return counts.withColumn("difference", F.col("accepted") - F.col("stored"))


def reconcile_tables(accepted: DataFrame, tables) -> DataFrame:
    """`reconcile` of the accepted log and the stored events, which joins ids only where something differs.

    Every batch has on record the fingerprint of the ids it received and of those it stored. Where the log's
    fingerprint is the sum of the received ones, and that of the stored events the sum of the stored ones, each
    accepted delivery went through a batch and nothing was lost after it: the ids of such a bucket are counted
    by name, on one side, without a shuffle of ids. Buckets that differ are compared id by id: what was
    lost or added, and streams that leave out copies before they store (their batches did not receive them).
    """
    stored = tables.events()
    received, inserted = tables.fingerprints()
    found = [rows.agg(fingerprint().alias("p")).first().p for rows in (accepted, stored)]
    differ = sorted({*differing_buckets(found[0], received), *differing_buckets(found[1], inserted)})
    among = print_bucket().isin(differ) if differ else F.lit(False)
    n = F.count(F.lit(1))
    counts = stored.filter(~among).groupBy("name").agg(n.alias("accepted"), n.alias("stored"))
    if differ:
        compared = reconcile(accepted.filter(among), stored.filter(among)).drop("difference")
        both = counts.unionByName(compared)
        counts = both.groupBy("name").agg(F.sum("accepted").alias("accepted"), F.sum("stored").alias("stored"))
    return counts.withColumn("difference", F.col("accepted") - F.col("stored"))
