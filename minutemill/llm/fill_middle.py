"""Fill-in-the-middle by block rotation: sentinels go into a byte array, whose blocks then change places.

A text is cut into prefix, middle and suffix at token ends. Sentinels are put before each part, which gives
`<P>prefix<M>middle<S>suffix`; one rotation by three reversals brings the parts into the order of the form,
and the inverse rotation brings them back. A reversal swaps blocks of bounded size from both ends, so beside
the text itself a task holds two such blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutemill.llm.common import BREAKS, id_and_text, map_batches, read_documents, slices

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Seed of the draws, percent of texts that are rearranged and, of these, percent with the suffix first.
SEED, RATE, SPM_RATE = 42, 50, 80
SWAPPED_BYTES = 1 << 16

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS.encode())] = True


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place."""
    while end - start > 1:
        n = min((end - start) // 2, SWAPPED_BYTES)
        left = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, split: int, end: int) -> None:
    """Exchange the blocks [start, split) and [split, end) in place; rotating at start + end - split undoes it."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, split)
    reverse(view, split, end)
    reverse(view, start, end)


def token_ends(data: bytes) -> np.ndarray:
    """Byte offsets at which tokens end; a token is a word with the white space before it, or the white
    space after the last word."""
    if not data:
        return np.zeros(0, np.int64)
    blank = _IS_BREAK[np.frombuffer(data, np.uint8)]
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.append(inner, len(data))


def rearrange(buffer: bytearray, form: str, first: int, second: int) -> None:
    """Bring a text, cut at the byte offsets `first` and `second`, into the order of `form` (psm or spm)."""
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    marks = len(PREFIX), len(PREFIX) + len(MIDDLE)
    rotate(buffer, first + marks[0] if form == "psm" else 0, second + marks[1], len(buffer))


def restore(buffer: bytearray, form: str) -> None:
    """Undo `rearrange`. Sentinels can't overlap, so each is where it is first found."""
    if form == "plain":
        return
    start = buffer.find(SUFFIX)
    split = buffer.find(MIDDLE if form == "psm" else PREFIX)
    rotate(buffer, start, split, len(buffer))
    suffix = start + len(buffer) - split
    middle = start if form == "psm" else buffer.find(MIDDLE)
    for at, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(mark)]


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())


def transform(doc_id: int | None, data: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = token_ends(data)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    draws = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
    if not data or draws[2] % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    places = sorted(d % (n + 1) for d in draws[:2])
    first, second = (int(ends[p - 1]) if p else 0 for p in places)
    buffer = bytearray(data)
    rearrange(buffer, form, first, second)
    return n, form, code_points(data[:first]), code_points(data[first:second]), bytes(buffer)


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _strings(texts: list) -> pa.Array:
    return pa.array(texts, pa.binary()).cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each document, row by row.

    n counts tokens. The form is plain (the text itself) for `100 - rate` percent of the ids, for empty
    texts and for texts that hold a sentinel; otherwise psm or spm, and prefix_chars and middle_chars count
    code points. A null text is empty. Draws depend on the id alone, so repeated rows give repeated rows; a
    null id is drawn as an empty one. Other columns stay behind; an empty table gives an empty one.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batch):
        for rows in slices(batch):
            ids = rows.column("doc_id").to_pylist()
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            made = list(zip(*(transform(i, t, seed, rate, spm_rate) for i, t in zip(ids, texts))))
            columns = dict(zip(names, map(list, made)))
            yield {"doc_id": rows.column("doc_id"), **columns, "output": _strings(columns["output"])}

    return map_batches(id_and_text(docs), run, f"doc_id long, {FIELDS}")


def restore_texts(rearranged: DataFrame) -> DataFrame:
    """The rows of `fill_in_middle` with `restored`, the text rebuilt from `output` and `form` alone."""

    def back(form: str, output: bytes) -> bytes:
        buffer = bytearray(output)
        restore(buffer, form)
        return bytes(buffer)

    def run(batch):
        for rows in slices(batch.rename_columns(["text" if c == "output" else c for c in batch.schema.names])):
            outputs = rows.column("text").cast(pa.binary()).to_pylist()
            kept = {c: rows.column("text" if c == "output" else c) for c in ["doc_id", *_names(FIELDS)]}
            yield {**kept, "restored": _strings(list(map(back, rows.column("form").to_pylist(), outputs)))}

    return map_batches(rearranged.select("doc_id", *_names(FIELDS)), run, f"doc_id long, {FIELDS}, restored string")


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_texts(fill_in_middle(read_documents(spark, sf_dir))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


_P, _S, _M = (f"'{mark.decode()}'" for mark in (PREFIX, SUFFIX, MIDDLE))
ORACLE = {
    "op11_fill_in_middle": f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h FROM documents),
    cut AS (
      SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
      FROM docs),
    formed AS (
      SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n,
        CASE WHEN t = '' OR contains(t, {_P}) OR contains(t, {_S}) OR contains(t, {_M}) OR h3 % 100 >= {RATE} THEN 'plain'
             WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b
      FROM cut),
    parts AS (
      SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
        array_to_string(w[b + 1:], '') AS s FROM formed)
    SELECT doc_id, n, form,
      CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {_P} || p || {_S} || s || {_M} || m
                       ELSE {_S} || s || {_P} || p || {_M} || m END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM parts
    """
}
QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
