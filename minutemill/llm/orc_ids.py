"""Token ids of a corpus in ORC files, in ascending doc_id order, and reading them back.

The files hold (part, doc_id, local_start, n_tokens, ids): integers run-length encoded by the format,
min and max of doc_id for every stripe and row group, and a Bloom filter on doc_id. A reader takes
stripes in parallel; a filter on doc_id opens only those that can hold the id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutemill.llm.chunks import shared, tokenizers_encoder
from minutemill.llm.common import id_and_text, map_batches, read_documents, slices
from minutemill.llm.packing import production_model
from minutemill.session import scratch_path

ROWS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
# Rows of an index entry, and bytes of a stripe before compression.
ROW_GROUP, STRIPE = 1000, 32 << 20


def token_rows(docs: DataFrame, model_json: str, end_id: int = 0) -> DataFrame:
    """Rows as in the files: sorted by doc_id within parts, and parts in the order of doc_id.

    A null text is empty and gives the end id alone. A null doc_id sorts before all others. Repeated
    ids stand side by side in the order of their text's hash. Other columns are left behind, an empty
    table gives no rows.
    """
    key = ("tokenizers", hashlib.sha256(model_json.encode()).hexdigest())
    order = ["doc_id", F.xxhash64("text")]
    ranged = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions(*order)

    def encode(batch, place=[None, 0]):  # noqa: B006  the running start of this task
        from pyspark import TaskContext

        task = TaskContext.get()
        if place[0] != task.taskAttemptId():
            place[:] = [task.taskAttemptId(), 0]
        encoder = shared(key, lambda: tokenizers_encoder(model_json))
        for rows in slices(batch):
            ids, bounds = encoder.encode(rows.column("text"))
            flat = np.insert(ids, bounds[1:], end_id).view("<i4")
            starts = bounds + np.arange(len(bounds))
            yield {
                "part": np.full(len(rows), task.partitionId(), np.int32),
                "doc_id": rows.column("doc_id"),
                "local_start": place[1] + starts[:-1],
                "n_tokens": np.diff(starts),
                "ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)),
            }
            place[1] += int(starts[-1])

    return map_batches(ranged, encode, ROWS)


def write_ids(rows: DataFrame, path: str) -> None:
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(STRIPE))
        .option("compression", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before this one.

    The totals per part, one short row for each file, are summed up before the parts; the ids don't
    move.
    """
    return with_starts(spark, path, spark.read.schema(ROWS).orc(path)).select("doc_id", "start", "n_tokens", "ids")


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """`rows` with (part, local_start) made from the files at `path`, plus start over all documents."""
    totals = spark.read.schema(ROWS).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; row groups whose range or Bloom filter excludes them are not decoded."""
    return spark.read.schema(ROWS).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Rows as in the files, with the checksum of their ids in place of the ids."""

    def digest(batch):
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        blob, ends = memoryview(flat.astype("<i4", copy=False)).cast("B"), (4 * ends.astype(np.int64)).tolist()
        sums = [zlib.crc32(blob[a:b]) for a, b in zip(ends, ends[1:])]
        same = {c: batch.column(c) for c in ("part", "doc_id", "local_start", "n_tokens")}
        yield {**same, "ids_crc32": np.array(sums, np.int64)}

    return map_batches(rows, digest, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def op9_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op9-ids")
    write_ids(token_rows(read_documents(spark, sf_dir), production_model()), path)
    # Checksums are taken before the starts are joined, so that ids don't move.
    sums = ids_crc32(spark.read.schema(ROWS).orc(path))
    return with_starts(spark, path, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op9_orc_ids": op9_orc_ids}
ORACLE: dict[str, str] = {}
