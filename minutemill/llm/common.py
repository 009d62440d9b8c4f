"""What the operators of this folder share: reading documents, words, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six characters that part words; Python's bytes.split() parts at exactly these.
BREAKS = " \t\n\x0b\x0c\r"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as empty; every other column stays behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def buckets_for(docs: DataFrame, each: int = 16 << 20, least: int = 64) -> int:
    """Buckets to deal the text of documents to: one for each `each` bytes of it, `least` at least.

    One pass over the column measures the text, so that a bucket stays as large as it is however much
    there is and whatever the session's number of shuffle partitions. No text at all gives `least`.
    """
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(least, -(-size // each))


def id_remainder(modulus: int) -> Column:
    """crc32 of doc_id as text modulo `modulus`; a null id counts as the empty text."""
    text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply fn(RecordBatch) -> iterator of {column: values} to each Arrow batch of each task."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield to_batch(columns, target)

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a list "name type, ..." of the types used here; works inside tasks."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def slices(batch: pa.RecordBatch, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `chars` bytes of text, one row at least."""
    column = batch.column("text")
    if column.null_count:
        raise ValueError("text must not be null here")
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


_WORD_HASHES: dict[bytes, int] = {}


def hashed_words(text: str, most: int = 200_000):
    """64-bit hashes of a text's lower-cased (A-Z) words, as a numpy array."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()
    known = _WORD_HASHES
    if len(known) > most:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str, size: int = 5):
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than `size` are one shingle."""
    import numpy as np

    words = hashed_words(text)
    n = len(words)
    if n == 0:
        return words
    count = max(1, n - size + 1)
    h = np.full(count, min(n, size), np.uint64)
    for k in range(min(n, size)):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over (a, b) links; nodes without links are absent.

    Every round takes the smallest label among a node and its neighbours, then the label of that label,
    so long chains shrink fast. Each round is written to the shared folder, which cuts the lineage.
    """
    from minutemill.session import scratch_path

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = written(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        least = seen.union(labels).groupBy("node").agg(F.min("component").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("component").alias("_jump"))
        moved = least.join(jump, "_low", "left").join(labels, "node")
        new = written(
            moved.select("node", F.least("_low", "_jump").alias("component"), F.col("component").alias("_was"))
        )
        labels = new.select("node", "component")
        if new.filter("component <> _was").isEmpty():
            return labels
