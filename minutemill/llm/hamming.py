"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments, each with an index from segment value to codes. Two codes within distance d
agree in some segment up to d / segments bits, rounded down. So a query looks up all values within radius 0
of its own segments, then 1, and so on; after radius r it has seen every code within
segments * (r + 1) - 1, and it stops once its kth verified distance is no larger than that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutemill.llm.common import arrow_schema, map_batches, to_batch

# Codes of an index part, queries that are taken through it at a time, and queries for which a part is
# copied once more, to be searched by another task.
PART, QUERIES_AT_ONCE, QUERIES_OF_A_PART = 1 << 17, 256, 1 << 18
_FOUND = "query binary, distance int, id long"


def binary_codes(rows: DataFrame) -> DataFrame:
    """(vec_id, code): one bit for each dimension, set where it is above zero.

    Rows with a null id or a null vector are left out; null and NaN entries count as not above zero, and a vector
    shorter than the longest one is filled up with zeros.
    """
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    known = known.filter("vec_id IS NOT NULL AND v IS NOT NULL")
    width = -(-(known.agg(F.max(F.size("v"))).first()[0] or 1) // 8)

    def run(batch):
        vectors = batch.column("v")
        codes = []
        for v in vectors.to_pylist():
            bits = np.packbits(np.array([x is not None and x > 0 for x in v], bool))
            codes.append(bits.tobytes().ljust(width, b"\0"))
        yield {"vec_id": batch.column("vec_id"), "code": codes}

    return map_batches(known, run, "vec_id long, code binary")


class MultiIndex:
    """Codes (rows of bytes) with the ids that have each, least ids first, -1 where there are fewer."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids = codes, ids
        bits = codes.shape[1] * 8
        # Segments of about log2(n) bits hold about one code for each value.
        self.segments = max(1, round(bits / max(4, min(20, np.log2(max(2, len(codes)))))))
        self.edges = [bits * i // self.segments for i in range(self.segments + 1)]
        self.values = self._cut(codes)
        self.order = [np.argsort(v, kind="stable") for v in self.values]
        widths = np.diff(self.edges)
        self.starts = [np.searchsorted(v[o], np.arange((1 << w) + 1)) for v, o, w in zip(self.values, self.order, widths)]

    def _cut(self, codes: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(codes, axis=1).astype(np.int64)
        return [bits[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1)) for a, b in zip(self.edges[:-1], self.edges[1:])]

    def nearest(self, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query code the k least (distance, id)."""
        own, n = self._cut(queries), len(queries)
        best = [[] for _ in range(n)]
        active = np.arange(n)
        for radius in range(max(np.diff(self.edges)) + 1):
            seen_q, seen_c = [], []
            for j in range(self.segments):
                width = self.edges[j + 1] - self.edges[j]
                masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
                if not len(masks):
                    continue
                value = (own[j][active][:, None] ^ masks[None, :]).ravel()
                begin, size = self.starts[j][value], self.starts[j][value + 1] - self.starts[j][value]
                hit = np.nonzero(size)[0]
                begin, size = begin[hit], size[hit]
                q = np.repeat(active[hit // len(masks)], size)
                at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
                c = self.order[j][at]
                # New unless an earlier segment or radius has found the same pair.
                new = np.ones(len(q), bool)
                for other in range(self.segments):
                    if other != j:
                        apart = np.bitwise_count(self.values[other][c] ^ own[other][q])
                        new &= apart > radius if other < j else apart >= radius
                seen_q.append(q[new])
                seen_c.append(c[new])
            if seen_q:
                self._take(best, np.concatenate(seen_q), np.concatenate(seen_c), queries, k)
            covered = self.segments * (radius + 1) - 1
            active = np.array([q for q in active.tolist() if len(best[q]) < k or best[q][-1][0] > covered], np.int64)
            if not len(active):
                break
        return best

    def _take(self, best, q, c, queries, k) -> None:
        distance = np.bitwise_count(self.codes[c] ^ queries[q]).sum(1, dtype=np.int64)
        limit = np.array([b[-1][0] if len(b) == k else 1 << 30 for b in best])
        keep = distance <= limit[q]
        q, c, distance = q[keep], c[keep], distance[keep]
        order = np.lexsort((distance, q))
        q, c, distance = q[order], c[order], distance[order]
        ends = np.searchsorted(q, np.arange(len(best) + 1))
        for i in np.unique(q).tolist():
            part = slice(ends[i], ends[i + 1])
            d = distance[part]
            # Codes nearer than the kth code, and all that are as far as it.
            d_max = d[min(k, len(d)) - 1]
            near = d <= d_max
            ids, ds = self.ids[c[part][near]], np.repeat(d[near][:, None], self.ids.shape[1], 1)
            there = ids >= 0 if ids.size else np.zeros_like(ids, bool)
            best[i] = sorted([*best[i], *zip(ds[there].tolist(), ids[there].tolist())])[:k]


def _code_rows(column: pa.Array) -> np.ndarray:
    codes = column.to_pylist()
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _searched(k: int):
    """Reads rows (part, kind, code, ids, split), sorted, in which codes of a part come before its queries."""
    target = arrow_schema(_FOUND)

    def table_of(batches: list[pa.RecordBatch]) -> MultiIndex:
        codes = np.concatenate([_code_rows(b.column("code")) for b in batches])
        ids = np.full((len(codes), k + 1), -1, np.int64)
        lists = pa.concat_arrays([b.column("ids") for b in batches])
        sizes = pa.compute.list_value_length(lists).to_numpy()
        column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[np.repeat(np.arange(len(codes)), sizes), column] = lists.flatten().to_numpy()
        return MultiIndex(codes, ids)

    def run(batches):
        held: list[pa.RecordBatch] = []
        index, at = None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("part", "split", "kind")]
            changes = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in columns:
                changes |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                place, kind = (columns[0][start], columns[1][start]), columns[2][start]
                if place != at:
                    held, index, at = [], None, place
                rows = batch.slice(start, end - start)
                if kind == 0:
                    held.append(rows)
                    continue
                if index is None and held:
                    index, held = table_of(held), []
                if index is None:  # a part without codes
                    continue
                for first in range(0, rows.num_rows, QUERIES_AT_ONCE):
                    some = rows.column("code").slice(first, QUERIES_AT_ONCE)
                    best = index.nearest(_code_rows(some), k + 1)
                    flat = [(code, d, i) for code, found in zip(some.to_pylist(), best) for d, i in found]
                    yield to_batch(dict(zip(target.names, map(list, zip(*flat)))) if flat else {c: [] for c in target.names}, target)

    return run


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k other rows of `codes` nearest to each row of `queries`.

    Both have (vec_id, code). Order: distance, then neighbor_id; a query's own id is not its neighbour. Equal
    codes are searched once, for index and queries alike; of each code the k + 1 least ids can matter.
    Rows with the same id and code are one. With fewer other rows than k all of them are returned.
    """
    by_id = Window.partitionBy("code").orderBy("vec_id")
    first = codes.distinct().withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1)
    classes = first.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    wanted = queries.select("code").distinct()
    parts = max(1, -(-classes.count() // PART))
    splits = max(1, -(-wanted.count() // QUERIES_OF_A_PART))
    part, split = F.pmod(F.xxhash64("code"), F.lit(parts)), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(splits))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Queries go to every part of the index; a part goes where its queries are, once for each split of them,
    # and comes before them, so a task holds one part and streams the queries past it.
    none = F.lit(None).cast("array<bigint>").alias("ids")
    index = classes.select(part.cast("int").alias("part"), F.lit(0).alias("kind"), "code", "ids").withColumn("split", each(splits))
    asked = wanted.select(F.lit(1).alias("kind"), "code", none, split.cast("int").alias("split")).withColumn("part", each(parts))
    dealt = index.unionByName(asked).repartition("part", "split").sortWithinPartitions("part", "split", "kind")
    found = dealt.mapInArrow(_searched(k), _FOUND)
    near = Window.partitionBy("query").orderBy("distance", "id")
    best = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1).drop("_n")
    pairs = queries.distinct().join(best, queries["code"] == best["query"]).filter("vec_id <> id")
    rank = F.row_number().over(Window.partitionBy("vec_id", "code").orderBy("distance", "id"))
    ranked = pairs.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", F.col("id").alias("neighbor_id"), F.col("distance").cast("long").alias("distance"))


def op6_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest_codes(codes, codes.filter("vec_id % 20 = 0"), 10)


QUERIES = {"op6_multi_index_topk": op6_multi_index_topk}
ORACLE = {
    "op6_multi_index_topk": """
    WITH bits AS (
      SELECT vec_id, i, coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false) AS bit
      FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    apart AS (
      SELECT q.vec_id, r.vec_id AS neighbor_id, count(*) FILTER (WHERE q.bit <> r.bit) AS distance
      FROM bits q JOIN bits r ON q.i = r.i AND q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id GROUP BY 1, 2)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance
    FROM apart QUALIFY rank <= 10
    """
}
