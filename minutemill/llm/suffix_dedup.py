"""Removing passages that an earlier document has, by merging Burrows-Wheeler transforms.

A 50-byte string that occurs in two documents must have the same least 24-byte hash in both, so strings
are dealt out by that hash: neighbouring windows with the same least hash are one region.
1. Tasks count the least hashes; those of one region only lead nowhere.
2. Blocks of documents send the regions of the others, each distinct string of a block once, to the bucket of
   the hash. Copies within a block that are not the first are known to go without that.
3. In a bucket equal strings become one, with the smallest doc_id. Strings that share a hash but differ are
   dealt to shards; the shards' transforms are merged and give the intervals of equal 50-byte strings,
   and with them the smallest doc_id that has each. Blocks get back the windows to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from minutemill.llm.bwt import window_minimum
from minutemill.llm.common import arrow_schema, id_and_text, read_documents, to_batch

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 2 << 20
# Bytes of strings whose transforms are merged at a time; strings of one hash are never parted.
MERGE_BYTES = 2 << 20

_TEXTS = "block long, ids binary, sizes binary, text binary, rest binary"
_HASHES = "target long, block long, hashes binary, counts binary"
_REGIONS = "target long, kind int, block long, hashes binary, ids binary, owners binary, places binary, sizes binary, text binary"
_SPANS = "block long, owners binary, places binary, sizes binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blob(values, dtype) -> bytes:
    return np.ascontiguousarray(values, dtype).tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int):
    """(block number, ids, texts, rows); the same for every reading of the same task's rows."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    ids, texts, rows, held = [], [], [], 0
    for batch in batches:
        begin = 0
        for i, (doc_id, text) in enumerate(zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()), 1):
            ids.append(doc_id)
            texts.append((text or "").encode())
            held += len(texts[-1])
            if held >= BLOCK_BYTES or len(ids) >= 50_000:
                yield number, ids, texts, [*rows, batch.slice(begin, i - begin)]
                number, ids, texts, rows, held, begin = number + 1, [], [], [], 0, i
        if begin < batch.num_rows:
            rows.append(batch.slice(begin))
    if ids:
        yield number, ids, texts, rows


_RNG = np.random.Generator(np.random.PCG64(50))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 1 << 64))


def least_hashes(text: np.ndarray) -> np.ndarray:
    """Least hash of the 24-byte strings within each window of 50 bytes."""
    h1 = _BYTE[text]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    h = h16[: len(text) - GRAM + 1] * _power(8) + h8[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    rest = LENGTH - GRAM + 1 - 16
    return np.minimum(h[:-rest], h[rest:])


def regions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place, bytes) of the maximal runs of windows with the same least hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < LENGTH:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    ends = np.cumsum(sizes)
    low = least_hashes(joined)
    valid = np.zeros(len(joined) + 1, np.int8)
    long_enough = sizes >= LENGTH
    valid[(ends - sizes)[long_enough]] += 1
    valid[ends[long_enough] - LENGTH + 1] -= 1
    valid = np.cumsum(valid)[: len(low)] > 0
    begins = np.ones(len(low), bool)
    begins[1:] = low[1:] != low[:-1]
    begins[(ends - sizes)[long_enough]] = True
    begins[1:] |= valid[1:] & ~valid[:-1]
    stops = ~valid
    at = np.nonzero(begins | stops)[0]
    length = np.diff(np.append(at, len(low)))
    keep = valid[at]
    at, length = at[keep], length[keep]
    owner = np.searchsorted(ends, at, side="right")
    return low[at], owner, at - (ends - sizes)[owner], length + LENGTH - 1


def _spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def removed_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Each byte of a text covered by a 50-byte string that also starts in a document with a smaller doc_id
    goes; texts are judged as they came. A null text is empty, a text under 50 bytes stays whole. Rows
    with a null doc_id are left out. Rows with the same doc_id are judged one by one and never against
    each other. Other columns are left behind, an empty table gives an empty one.
    """
    target = arrow_schema(_RESULT)

    def digest(ids: np.ndarray, texts: list[bytes], masks: list[np.ndarray], rest: bytes) -> pa.Table:
        rows = {c: [] for c in target.names}
        for doc_id, text, mask in zip(ids.tolist(), texts, masks):
            removed = int(mask.sum())
            spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            for c, v in zip(rows, (doc_id, len(text), removed, spans, hashlib.sha256(_left(text, mask)).hexdigest())):
                rows[c].append(v)
        return pa.Table.from_batches([to_batch(rows, target)])

    return _removal(id_and_text(docs.filter("doc_id IS NOT NULL")), False, digest, _RESULT)


def _left(text: bytes, mask: np.ndarray) -> bytes:
    return np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text


def _removal(docs: DataFrame, with_rows: bool, finish, result) -> DataFrame:
    """finish(ids, texts, masks of removed bytes, the block's rows as an Arrow stream) for every block."""
    import zstandard

    spark = docs.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashes_schema, regions_schema = arrow_schema(_HASHES), arrow_schema(_REGIONS)
    texts_schema, spans_schema = arrow_schema(_TEXTS), arrow_schema(_SPANS)
    at = docs.columns.index("doc_id"), docs.columns.index("text")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for block, ids, texts, rows in _blocks(batches, *at):
            stream = pa.BufferOutputStream()
            if with_rows:
                others = [batch.set_column(at[1], "text", pa.nulls(batch.num_rows)) for batch in rows]
                with pa.ipc.new_stream(stream, others[0].schema) as out:
                    for batch in others:
                        out.write_batch(batch)
            columns = {
                "block": [block], "ids": [_blob(ids, "<i8")], "sizes": [_blob([len(t) for t in texts], "<i8")],
                "text": [squeeze(b"".join(texts))], "rest": [squeeze(stream.getvalue().to_pybytes())],
            }
            yield to_batch(columns, texts_schema)

    def count_hashes(batches):
        for block, _, texts, _ in _blocks(batches, *at):
            unique, counts = np.unique(regions(texts)[0], return_counts=True)
            place = _spread(unique, buckets)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(buckets + 1))
            rows = {c: [] for c in hashes_schema.names}
            for b in np.nonzero(np.diff(ends))[0].tolist():
                part = order[ends[b] : ends[b + 1]]
                values = (b, block, _blob(unique[part], "<u8"), _blob(np.minimum(counts[part], 2), "u1"))
                for c, v in zip(rows, values):
                    rows[c].append(v)
            yield to_batch(rows, hashes_schema)

    def find_shared(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        hashes = np.concatenate(parts)
        counts = np.concatenate([np.frombuffer(x, "u1") for x in table.column("counts").to_pylist()])
        values, inverse = np.unique(hashes, return_inverse=True)
        shared = (np.bincount(inverse, counts, len(values)) > 1)[inverse]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        rows = {c: [] for c in hashes_schema.names}
        for i, block in enumerate(table.column("block").to_pylist()):
            found = hashes[ends[i] : ends[i + 1]][shared[ends[i] : ends[i + 1]]]
            if len(found):
                for c, v in zip(rows, (0, block, _blob(found, "<u8"), b"")):
                    rows[c].append(v)
        return pa.Table.from_batches([to_batch(rows, hashes_schema)])

    def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
        row = table.to_pylist()[0]
        ids, sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        return ids, sizes, zstandard.ZstdDecompressor().decompress(row["text"]) if sizes.sum() else b""

    def send_regions(text_rows: pa.Table, hash_rows: pa.Table) -> pa.Table:
        rows = {c: [] for c in regions_schema.names}
        if text_rows.num_rows and hash_rows.num_rows:
            block = text_rows.column("block")[0].as_py()
            ids, sizes, joined = unpack(text_rows)
            starts = np.cumsum(sizes) - sizes
            shared = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in hash_rows.column("hashes").to_pylist()]))
            texts = [joined[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())]
            low, owner, place, length = regions(texts)
            at = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
            keep = np.nonzero(shared[at] == low)[0]
            low, owner, place, length = low[keep], owner[keep], place[keep], length[keep]
            begin = (starts[owner] + place).tolist()
            strings = [joined[a : a + n] for a, n in zip(begin, length.tolist())]
            doc = ids[owner]
            number: dict[bytes, int] = {}
            which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            late = doc > least[which]
            base = dict.fromkeys(regions_schema.names, b"") | {"block": block}
            local = base | {"target": block % buckets, "kind": 1}
            local |= {"owners": _blob(owner[late], "<i4"), "places": _blob(place[late], "<i4")}
            local |= {"sizes": _blob(length[late], "<i4")}
            todo = [local]
            early = np.nonzero(~late)[0]
            target = _spread(low[early], buckets)
            early = early[np.argsort(target, kind="stable")]
            target = np.sort(target)
            ends = np.searchsorted(target, np.arange(buckets + 1))
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for b in np.nonzero(np.diff(ends))[0].tolist():
                part = early[ends[b] : ends[b + 1]]
                sent = base | {"target": b, "kind": 2, "hashes": _blob(low[part], "<u8"), "ids": _blob(doc[part], "<i8")}
                sent |= {"owners": _blob(owner[part], "<i4"), "places": _blob(place[part], "<i4")}
                sent |= {"sizes": _blob(length[part], "<i4")}
                todo.append(sent | {"text": squeeze(b"".join(strings[i] for i in part.tolist()))})
            for row in todo:
                for c in rows:
                    rows[c].append(row[c])
        return pa.Table.from_batches([to_batch(rows, regions_schema)])

    def compare(table: pa.Table) -> pa.Table:
        out = {c: [] for c in spans_schema.names}
        inner: dict[int, dict[bytes, int]] = {}
        sent = []
        for row in table.to_pylist():
            if row["kind"] == 1:
                for c in out:
                    out[c].append(row[c])
                continue
            names = ("hashes", "<u8"), ("ids", "<i8"), ("owners", "<i4"), ("places", "<i4"), ("sizes", "<i4")
            low, doc, owner, place, size = (np.frombuffer(row[c], kind) for c, kind in names)
            text, at, strings = zstandard.ZstdDecompressor().decompress(row["text"]), 0, []
            for value, doc_id, n in zip(low.tolist(), doc.tolist(), size.tolist()):
                string = text[at : at + n]
                at += n
                strings.append(string)
                group = inner.setdefault(value, {})
                group[string] = min(doc_id, group.get(string, doc_id))
            sent.append((row["block"], low, doc, owner, place, size, strings))
        least: dict[bytes, np.ndarray | int] = {}
        batch: list[tuple[bytes, int]] = []

        def merge_batch():
            strings, values = [s for s, _ in batch], np.array([v for _, v in batch], np.int64)
            for string, minimum, own in zip(strings, window_minimum(strings, values, LENGTH), values):
                least[string] = minimum if (minimum < own).any() else int(own)
            batch.clear()

        held = 0
        for group in inner.values():
            if len(group) == 1:  # one string only: it is one interval of every depth
                least.update(group)
                continue
            batch.extend(group.items())
            held += sum(map(len, group))
            if held >= MERGE_BYTES:
                merge_batch()
                held = 0
        if batch:
            merge_batch()
        for block, _, doc, owner, place, size, strings in sent:
            owners, places, sizes = [], [], []
            for i, (string, doc_id) in enumerate(zip(strings, doc.tolist())):
                minimum = least[string]
                if isinstance(minimum, int):
                    if minimum < doc_id:
                        owners.append(owner[i])
                        places.append(place[i])
                        sizes.append(size[i])
                    continue
                hit = np.concatenate(([False], minimum < doc_id, [False]))
                edge = np.nonzero(hit[1:] != hit[:-1])[0]
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    owners.append(owner[i])
                    places.append(place[i] + a)
                    sizes.append(b - a + LENGTH - 1)
            for c, v in zip(out, (block, *(_blob(x, "<i4") for x in (owners, places, sizes)))):
                out[c].append(v)
        return pa.Table.from_batches([to_batch(out, spans_schema)])

    def remove(text_rows: pa.Table, span_rows: pa.Table) -> pa.Table:
        ids, sizes, joined = unpack(text_rows)
        starts = np.cumsum(sizes) - sizes
        edges = np.zeros(len(joined) + 1, np.int32)
        for row in span_rows.to_pylist():
            owner, place, size = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("owners", "places", "sizes"))
            begin = starts[owner] + place
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + size, -1)
        gone = np.cumsum(edges[:-1]) > 0
        cuts = list(zip(starts.tolist(), (starts + sizes).tolist()))
        rest = zstandard.ZstdDecompressor().decompress(text_rows.column("rest")[0].as_py()) if with_rows else b""
        return finish(ids, [joined[a:b] for a, b in cuts], [gone[a:b] for a, b in cuts], rest)

    texts = docs.mapInArrow(pack, _TEXTS)
    shared = docs.mapInArrow(count_hashes, _HASHES).groupBy("target").applyInArrow(find_shared, _HASHES)
    sent = texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_regions, _REGIONS)
    spans = sent.groupBy("target").applyInArrow(compare, _SPANS)
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, result)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents without the passages that an earlier one has; columns and rows as they came.

    A character of which only some bytes were covered goes as a whole. n_chars, where there is such a column,
    counts what is left. A text from which nothing goes stays as it is, null ones too. Rows with a null
    doc_id stay as they are. Whole rows travel with their block, so no table is joined.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(docs.schema)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def rebuild(ids: np.ndarray, texts: list[bytes], masks: list[np.ndarray], rest: bytes) -> pa.Table:
        rows = pa.ipc.open_stream(rest).read_all()
        columns = list(rows.columns)
        kept = [_left(t, m).decode("utf-8", "ignore") for t, m in zip(texts, masks)]
        columns[text_at] = pa.chunked_array([pa.array(kept, target.field(text_at).type)])
        if chars_at is not None:
            own = columns[chars_at].to_pylist()
            counts = [len(k) if m.any() else n for k, m, n in zip(kept, masks, own)]
            columns[chars_at] = pa.chunked_array([pa.array(counts, pa.int64()).cast(target.field(chars_at).type)])
        return pa.table(columns, schema=target)

    known = _removal(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL"), True, rebuild, docs.schema)
    return known.union(docs.filter("doc_id IS NULL OR text IS NULL"))


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_passages(read_documents(spark, sf_dir))


QUERIES = {"op10_bwt_dedup": op10_bwt_dedup}
ORACLE: dict[str, str] = {}
