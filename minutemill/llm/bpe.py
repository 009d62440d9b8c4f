"""Byte-level BPE through a sentencepiece model written straight from a vocabulary of ranks."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from minutemill.llm.chunks import PartEncoder, shared
from minutemill.llm.common import id_and_text, map_batches, read_documents, slices


def byte_symbols() -> list[str]:
    """A visible character for each byte: itself where it is printable, else the next one from 256 on."""
    out, free = [], 256
    for byte in range(256):
        if chr(byte).isprintable() and byte != 0x20:
            out.append(chr(byte))
        else:
            out.append(chr(free))
            free += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: pieces in byte symbols, score = -rank, text left as it is.

    Pieces stand in the order of rank and the unknown piece last, so a piece's place among them is its
    id where the ranks have no gap. All 256 single bytes must have a rank.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    symbols = byte_symbols()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no rank for the bytes {missing[:5]}")
    model = pb.ModelProto()
    for token in sorted(ranks, key=ranks.__getitem__):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join(symbols[b] for b in token), -float(ranks[token])
        piece.type = pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    rules = model.normalizer_spec
    rules.name = "identity"
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encode and decode with a serialised model; ids are the ranks."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self._matches = regex.compile(pattern).findall
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        symbols = byte_symbols()
        self._table = {byte: symbol for byte, symbol in enumerate(symbols)}
        back = {symbol: byte for byte, symbol in enumerate(symbols)}
        size = self._sp.get_piece_size() - 1
        pieces = [self._sp.id_to_piece(i) for i in range(size)]
        self._bytes = [bytes(back[c] for c in piece) for piece in pieces]
        self._rank = np.array([-self._sp.get_score(i) for i in range(size)], "<u4")
        self._whole = {piece: i for i, piece in enumerate(pieces)}
        self._by_rank = dict(zip(self._rank.tolist(), self._bytes))
        self.encode_texts = PartEncoder(self._encode_parts)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Each match of the pattern apart; a match that is a piece as a whole is that piece."""
        matches = [self._matches(part) for part in parts]
        mapped = {
            m: m.encode().decode("latin-1").translate(self._table) for m in set().union(*matches)
        }
        known = {m: [self._whole[s]] for m, s in mapped.items() if s in self._whole}
        rest = [m for m in mapped if m not in known]
        known.update(zip(rest, self._sp.encode([mapped[m] for m in rest], num_threads=1)))
        rank = self._rank
        return [rank[np.array([i for m in found for i in known[m]], np.int64)].tobytes() for found in matches]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self._by_rank.__getitem__, np.frombuffer(ids, "<u4").tolist()))


CODEC = "doc_id long, ids binary, decoded binary"


def encode_documents(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and what they decode to.

    A null text is empty and gives no ids. A null doc_id stays null. Repeated rows give repeated rows,
    other columns are left behind, an empty table gives an empty one. Rows are independent.
    """
    return _through(docs, model, pattern, CODEC, lambda ids, decoded: {"ids": ids, "decoded": decoded})


def encode_digests(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """encode_documents with digests taken beside the codec, so that whole texts don't travel back."""

    def digest(ids, decoded):
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _through(docs, model, pattern, schema, digest)


def _through(docs: DataFrame, model: bytes, pattern: str, schema: str, finish) -> DataFrame:
    key = ("sentencepiece", hashlib.sha256(model + pattern.encode()).hexdigest())

    def run(batch):
        codec = shared(key, lambda: ByteBpe(model, pattern))
        for rows in slices(batch):
            ids = codec.encode_texts(rows.column("text"))
            yield {"doc_id": rows.column("doc_id"), **finish(ids, [codec.decode(x) for x in ids])}

    return map_batches(id_and_text(docs), run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = serialise_model(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return encode_digests(read_documents(spark, sf_dir), model, public_tokenizers.PATTERN)


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLE: dict[str, str] = {}
