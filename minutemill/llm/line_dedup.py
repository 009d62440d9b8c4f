"""Line de-duplication: hashes of lines in ranges, read in order, and a keep bitmap for each document.

Every line long enough becomes a row (hash of its key, document, position). The rows are dealt out by ranges
of (hash, document) and sorted by (hash, document, position), largest document first, so that the first
occurrences of a key are the ones that stay and all others pass by in one stream. A key that fills many
ranges is no hot spot: each range decides what it can, and hands the few lines that depend on its neighbours
on together with a short summary of the two keys at its ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.llm.common import arrow_schema, id_and_text, map_batches, read_documents, slices, to_batch
from minutemill.session import scratch_path

# Keys have this many code points at least and are dropped when this many documents hold them.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
# Lines that one range should hold.
ROWS_PER_RANGE = 2_000_000

_DROP, _OPEN, _SUMMARY = 0, 1, 2
_LINE = "high long, low long, doc long, print long, position int"
_FOUND = f"kind int, {_LINE}, documents long"
_NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null as the least number), print (a hash of the text) and text: together the row's identity."""
    return id_and_text(docs).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("print"), "text"
    )


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _lines(keyed: DataFrame, least_chars: int) -> DataFrame:
    """One row for each line whose key is long enough."""

    def run(batch):
        for rows in slices(batch):
            places, digests, counts = [], [], []
            for text in rows.column("text").cast(pa.binary()).to_pylist():
                keys = [(i, line_key(line)) for i, line in enumerate(text.split(b"\n")) if len(line) >= least_chars]
                found = [(i, k) for i, k in keys if _long_enough(k, least_chars)]
                counts.append(len(found))
                places += [i for i, _ in found]
                digests += [xxhash.xxh3_128_digest(k) for _, k in found]
            hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield {
                "high": pa.array(hashes[:, 0]), "low": pa.array(hashes[:, 1]), "doc": rows.column("doc").take(owner),
                "print": rows.column("print").take(owner), "position": pa.array(places, pa.int32()),
            }

    return map_batches(keyed, run, _LINE)


class _Range:
    """Reads the sorted lines of one range, as arrays with the columns of _LINE, and yields
    (kind, lines, documents).

    Within a key, lines of the first (largest) document stay; those of the others go once the key has
    `least` documents, and until then the lines of at most `least - 1` documents wait. The keys at the two
    ends of the range may go on in its neighbours: what isn't settled is open, with a summary of the key.
    """

    def __init__(self, least: int):
        self.least = least
        self.first: np.ndarray | None = None  # first line of the key being read
        self.doc, self.documents, self.waiting = None, 0, []
        self.at_start = True

    def read(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        if self.first is not None:
            new[0] = (rows[0, :2] != self.first[:2]).any()
        starts = np.flatnonzero(new)
        if not len(starts):
            yield from self._more(rows)
            return
        yield from self._more(rows[: starts[0]])
        if self.first is not None:
            yield from self._end(False)
        elif len(starts) > 1:
            yield from self._more(rows[: starts[1]])
            yield from self._end(False)
            starts = starts[1:]
        yield from self._whole(rows[starts[0] : starts[-1]], starts[:-1] - starts[0])
        yield from self._more(rows[starts[-1] :])

    def _whole(self, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Keys that begin and end among `rows`."""
        if not len(rows):
            return
        new_doc = np.ones(len(rows), bool)
        new_doc[1:] = rows[1:, 2] != rows[:-1, 2]
        new_doc[starts] = True
        seen = np.cumsum(new_doc)
        lengths = np.diff(np.append(starts, len(rows)))
        rank = seen - np.repeat(seen[starts] - 1, lengths)
        documents = np.repeat(rank[np.append(starts[1:], len(rows)) - 1], lengths)
        dropped = (rank > 1) & (documents >= self.least)
        if dropped.any():
            yield _DROP, rows[dropped], 0

    def _more(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Lines of one key: the one being read, or a new one."""
        if not len(rows):
            return
        new_doc = np.ones(len(rows), bool)
        new_doc[1:] = rows[1:, 2] != rows[:-1, 2]
        if self.first is None:
            self.first = rows[0].copy()
        else:
            new_doc[0] = rows[0, 2] != self.doc
        rank = self.documents + np.cumsum(new_doc)
        self.doc, self.documents = rows[-1, 2], int(rank[-1])
        if self.at_start and (rank == 1).any():
            yield _OPEN, rows[rank == 1], 0
        self.waiting.append(rows[rank > 1].copy())
        if self.documents >= self.least:
            yield _DROP, np.concatenate(self.waiting), 0
            self.waiting = []

    def _end(self, at_end: bool) -> Iterator[tuple[int, np.ndarray, int]]:
        if self.at_start or at_end:
            if self.waiting:
                yield _OPEN, np.concatenate(self.waiting), 0
            yield _SUMMARY, self.first[None, :], self.documents
        self.first, self.doc, self.documents, self.waiting, self.at_start = None, None, 0, [], False

    def finish(self) -> Iterator[tuple[int, np.ndarray, int]]:
        if self.first is not None:
            yield from self._end(True)


def _first_occurrences(lines: DataFrame, least: int) -> DataFrame:
    """Reads each sorted partition of `lines` in order; rows of _FOUND."""
    target = arrow_schema(_FOUND)
    names = [f.split()[0] for f in _LINE.split(", ")]

    def run(batches):
        state = _Range(least)

        def found(parts):
            for kind, rows, documents in parts:
                if len(rows):
                    columns = {name: pa.array(rows[:, i]).cast(target.field(name).type) for i, name in enumerate(names)}
                    constant = {"kind": np.full(len(rows), kind, np.int32), "documents": np.full(len(rows), documents, np.int64)}
                    yield to_batch({**columns, **{k: pa.array(v) for k, v in constant.items()}}, target)

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
                yield from found(state.read(rows))
        yield from found(state.finish())

    return lines.mapInArrow(run, _FOUND)


def dropped_lines(spark: SparkSession, keyed: DataFrame, least_chars: int, least_documents: int) -> DataFrame:
    """(doc, print, position) of the lines that go, from rows (doc, print, text).

    The lines are written once, as the ranges are first sampled and then filled; so are the findings,
    which are read as drops, as open lines and as summaries (two for each range at most).
    """
    lines_at, found_at = scratch_path(spark, "lines"), scratch_path(spark, "first-occurrences")
    _lines(keyed, least_chars).write.parquet(lines_at)
    lines = spark.read.schema(_LINE).parquet(lines_at)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS_PER_RANGE))
    by = ["high", "low", F.desc("doc")]
    ordered = lines.repartitionByRange(ranges, *by).sortWithinPartitions(*by, "print", "position")
    _first_occurrences(ordered, least_documents).write.parquet(found_at)
    found = spark.read.schema(_FOUND).parquet(found_at)
    keys = found.filter(F.col("kind") == _SUMMARY).groupBy("high", "low")
    spread = keys.agg(F.max("doc").alias("_largest"), F.sum("documents").alias("_documents"))
    late = (F.col("_documents") >= least_documents) & (F.col("doc") < F.col("_largest"))
    settled = found.filter(F.col("kind") == _OPEN).join(spread.filter(F.col("_documents") >= least_documents), ["high", "low"]).filter(late)
    columns = ["doc", "print", "position"]
    return found.filter(F.col("kind") == _DROP).select(*columns).unionAll(settled.select(*columns))


def keep_bitmaps(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """(doc_id, print, n_lines, n_dropped, keep): one row for each document, text left behind.

    `keep` is a zlib-compressed bitmap of the lines (split at \\n, first line in the lowest bit) that stay;
    `print` is xxhash64 of the text, by which `kept_texts` finds the row again where ids repeat. A line
    goes if its key (white space stripped at both ends, A-Z lower-cased) has at least `least_chars` code
    points, stands in at least `least_documents` documents and in one with a larger id. Documents with
    one id count as one; a null id is the least of all. A null or empty text is one empty line. Repeated
    rows give repeated rows, other columns stay behind, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    # Repeated rows bring a line more than once; as a set its position counts once.
    gone = dropped_lines(spark, keyed, least_chars, least_documents).groupBy("doc", "print")
    gone = gone.agg(F.collect_set("position").alias("gone"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = keyed.select("doc", "print", (breaks + 1).cast("long").alias("n_lines"))

    def run(batch):
        dropped = batch.column("gone")
        starts = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(dropped), 0).to_numpy()))
        places, n_lines = dropped.flatten().to_numpy(), batch.column("n_lines").to_numpy()
        keep = []
        for i, n in enumerate(n_lines):
            bits = np.ones(n, bool)
            bits[places[starts[i] : starts[i + 1]]] = False
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        counts = pa.array(np.diff(starts).astype(np.int64))
        yield {**{c: batch.column(c) for c in ("doc", "print", "n_lines")}, "n_dropped": counts, "keep": keep}

    made = map_batches(
        rows.join(gone, ["doc", "print"], "left"), run, "doc long, print long, n_lines long, n_dropped long, keep binary"
    )
    return made.select(_doc_id(), "print", "n_lines", "n_dropped", "keep")


def _doc_id():
    return F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id")


def kept_texts(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the lines that the bitmaps of `keep_bitmaps` keep, joined by \\n."""
    doc = F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc")
    once = bitmaps.select(doc, "print", "n_lines", "n_dropped", "keep").dropDuplicates(["doc", "print"])
    marked = _keyed(docs).join(once, ["doc", "print"])

    def kept(text: bytes, n_dropped: int, keep: bytes) -> bytes:
        if not n_dropped:
            return text
        lines = text.split(b"\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
        return b"\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])

    def run(batch):
        for rows in slices(batch):
            n_dropped = rows.column("n_dropped")
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            left = map(kept, texts, n_dropped.to_pylist(), rows.column("keep").to_pylist())
            yield {
                "doc": rows.column("doc"), "n_lines": rows.column("n_lines"), "n_dropped": n_dropped,
                "text": pa.array(list(left), pa.binary()).cast(pa.string()),
            }

    made = map_batches(marked, run, "doc long, n_lines long, n_dropped long, text string")
    return made.select(_doc_id(), "n_lines", "n_dropped", "text")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return kept_texts(docs, keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE = {
    "op12_line_dedup": f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
    keyed AS (
      SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    spread AS (
      SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= {LEAST_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS})
    SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.largest > k.doc_id) AS n_dropped,
      sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE s.largest IS NULL OR s.largest = k.doc_id), ''))
        AS kept_sha256
    FROM keyed k LEFT JOIN spread s USING (key) GROUP BY k.doc_id
    """
}
QUERIES = {"op12_line_dedup": op12_line_dedup}
