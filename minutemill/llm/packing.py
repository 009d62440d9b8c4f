"""Packing documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from minutemill.llm.chunks import shared, tokenizers_encoder
from minutemill.llm.common import arrow_schema, id_and_text, read_documents, slices, to_batch

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size: largest differencing over `windows` sums.

    Each size begins as a partition of its own, all sums but one zero. The two partitions with the
    widest spread merge again and again, the large sums of one with the small sums of the other. A
    window of a merged partition remembers the two it came from; walking back from the last partition
    gives every size its window.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray]] = []
    total, order = n, n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        sums, left, right = a + b[::-1], a_nodes, b_nodes[::-1]
        both = (left >= 0) & (right >= 0)
        nodes = np.maximum(left, right)
        count = int(both.sum())
        nodes[both] = np.arange(total, total + count)
        joined.append((left[both], right[both]))
        total += count
        by_sum = np.argsort(sums, kind="stable")
        sums = sums[by_sum] - sums[by_sum[0]]
        order += 1
        heapq.heappush(heap, (-int(sums[-1]), order, sums, nodes[by_sum]))
    window = np.full(total, -1, np.int64)
    final = heap[0][3]
    window[final[final >= 0]] = np.nonzero(final >= 0)[0]
    end = total
    for left, right in reversed(joined):
        begin = end - len(left)
        window[left] = window[right] = window[begin:end]
        end = begin
    return window[:n]


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): the count rises until no window exceeds capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, sizes, windows).max(initial=0) <= capacity:
            return window, windows
        windows += 1


def pack_documents(
    docs: DataFrame, model_json: str, capacity: int = 1024, grain: int = 256, group: int = 1024, end_id: int = 0
) -> DataFrame:
    """Pieces of documents with their place in a sequence of at most `capacity` ids.

    A document's ids are cut at every `capacity` ids into whole sequences; what is left is cut at every
    `grain` ids, and `group` such pieces at a time are packed into near-equal windows. Groups are taken
    as documents come in a task, so nothing is shuffled and a task holds one group. sequence_id is
    the task's number times 2^32 plus a count. The reader pads a sequence to `capacity` unless its length
    is a power of two; `ids` are little-endian unsigned 32-bit integers.

    A null text is empty and gives one piece with the end id. A null doc_id stays null. Repeated rows are
    packed one by one, other columns are left behind, an empty table gives no pieces.
    """
    key = ("tokenizers", hashlib.sha256(model_json.encode()).hexdigest())
    target = arrow_schema(PIECES)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shared(key, lambda: tokenizers_encoder(model_json))
        base, made = TaskContext.get().partitionId() << 32, 0
        whole: list[tuple] = []
        short: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, short, whole
            rows = [(*piece, base + made + i, 0) for i, piece in enumerate(whole)]
            made += len(whole)
            if short:
                sizes = np.array([len(p[2]) // 4 for p in short], np.int64)
                window, _ = pack(sizes, capacity)
                used, window = np.unique(window, return_inverse=True)
                filled = np.zeros(len(used), np.int64)
                for piece, size, w in zip(short, sizes.tolist(), window.tolist()):
                    rows.append((*piece, base + made + w, int(filled[w])))
                    filled[w] += size
                made += len(used)
            whole, short = [], []
            doc_id, start, ids, doc_tokens, sequence, offset = zip(*rows)
            columns = {
                "doc_id": list(doc_id), "start": list(start), "length": [len(x) // 4 for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids], "doc_tokens": list(doc_tokens),
                "sequence_id": list(sequence), "offset": list(offset), "ids": list(ids),
            }
            return to_batch(columns, target)

        for batch in batches:
            for rows in slices(batch):
                encoded = encoder(rows.column("text"))
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoded):
                    ids += end
                    n, full = len(ids) // 4, len(ids) // 4 // capacity * capacity
                    for start in range(0, full, capacity):
                        whole.append((doc_id, start, ids[4 * start : 4 * (start + capacity)], n))
                    for start in range(full, n, grain):
                        short.append((doc_id, start, ids[4 * start : 4 * min(n, start + grain)], n))
                    if len(short) >= group or len(whole) >= group:
                        yield flush()
        if short or whole:
            yield flush()

    return id_and_text(docs).mapInArrow(run, PIECES)


def production_model() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op8_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), production_model()).drop("ids")


QUERIES = {"op8_kk_packing": op8_kk_packing}
ORACLE: dict[str, str] = {}
