"""The ids of all stored events, laid out so that a batch is compared with few of them.

A new batch adds its ids as one part, sorted by hash (bucket RECENT). `fold` moves recent parts into BUCKETS
buckets, each sorted by hash, with Parquet statistics, page indexes and Bloom filters on the hash. `probe`
reads the recent parts and, of the folded ones, the buckets that the batch has ids in; for a small batch the
hashes themselves go down to the scan, which then skips row groups and pages without any of them. All
history is covered, whatever is skipped.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from minutemill.sources.tables import EventTables

BUCKETS = 256
RECENT = -1
# Up to this many ids of a batch are pushed to the scan, in lists that Spark hands to Parquet (their length
# is that of session.RUNTIME_CONF); the scan of a larger batch reads its buckets and its ids are joined.
PUSHED_IDS, LIST_LENGTH = 2_000, 100
# Folding rewrites a bucket that has come to this many parts.
MOST_PARTS = 8
# Small row groups, so that few ids are read beside one that is asked for.
_LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.bloom.filter.enabled#id_hash": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def bucket_of(id_hash: Column | str) -> Column:
    return F.pmod(F.col(id_hash) if isinstance(id_hash, str) else id_hash, F.lit(BUCKETS)).cast("int")


def hashed_ids(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.xxhash64("event_id").alias("id_hash"))


def _among(hashes: list[int]) -> Column:
    ordered = sorted(hashes)
    lists = [", ".join(f"{h}L" for h in ordered[i : i + LIST_LENGTH]) for i in range(0, len(ordered), LIST_LENGTH)]
    return F.expr(" OR ".join(f"id_hash IN ({texts})" for texts in lists) or "false")


def probe(tables: EventTables, batch: DataFrame, other_than: str | None = None) -> DataFrame:
    """(event_id) of stored ids, without those of batch `other_than`: all that `batch` holds are among them.

    At most PUSHED_IDS + 1 hashes come to the driver.
    """
    hashes = hashed_ids(batch).select("id_hash").distinct().limit(PUSHED_IDS + 1).collect()
    few = [row.id_hash for row in hashes] if len(hashes) <= PUSHED_IDS else None
    condition = F.lit(True)
    if few is not None:
        wanted = sorted({RECENT, *(h % BUCKETS for h in few)})
        condition = F.expr(f"bucket IN ({', '.join(map(str, wanted))})")
    parts = tables.manifest.live((F.col("table") == "event_ids") & condition)
    own = other_than is not None
    rows = tables.read_parts("event_ids", [p for p in parts if not own or p.batch_id != other_than])
    return (rows if few is None else rows.filter(_among(few))).select("event_id")


def fold(tables: EventTables) -> int:
    """Move recent ids into their buckets and rewrite crowded buckets; returns the number of parts folded.

    Ranges of (bucket, hash) spread a large bucket over tasks and give its files disjoint hashes. Batches whose
    ids were folded can't be replaced any more.
    """
    held: dict[int, list] = {}
    for part in tables.snapshot().parts("event_ids"):
        held.setdefault(part.bucket, []).append(part)
    recent = held.pop(RECENT, [])
    if not recent:
        return 0
    crowded = [p for parts in held.values() if len(parts) >= MOST_PARTS for p in parts]
    ids = tables.read_parts("event_ids", [*recent, *crowded]).withColumn("bucket", bucket_of("id_hash"))
    dealt = ids.repartitionByRange("bucket", "id_hash")
    _, added, _ = tables._write("event_ids", dealt, "bucket", ("id_hash",), _LAYOUT)
    tables.manifest.commit(added, [*recent, *crowded])
    return len(recent) + len(crowded)
