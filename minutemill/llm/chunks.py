"""Byte-level BPE of whole texts by way of a bounded memory of pieces already encoded.

The pre-tokenizer's pattern never joins what comes before a space with a space that is followed by
something visible: runs of white space give up their last space to the word behind it, and the rest of
the run is matched in the same way whether the text goes on or ends there. So a text may be cut before
every such space and its parts encoded apart from each other, with equal ids. The same holds before a line
break that is followed by something visible, which is a match by itself, and before a mark behind a letter or
digit, where a match begins. Parts repeat, texts do not, which is why parts are remembered.

Texts are cut as bytes, many at once, and a part is looked up once for all its places among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

_SPACE, _BREAK = 0x20, 0x0A
# Parts whose ids are put in place at a time.
BLOCK = 1 << 18


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


# First bytes of characters that are visible for sure, and those of a few that may be white space, with the second
# bytes that may make them so.
_VISIBLE = _table(bytes(range(0x21, 0x7F)) + bytes(range(0xC3, 0x100)))
_UNSURE = {0xC2: b"\x85\xa0", 0xE1: b"\x9a\xa0", 0xE2: b"\x80\x81", 0xE3: b"\x80"}
_VISIBLE[list(_UNSURE)] = False
_MARK = _table(b".,;:!?")
_WORD = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)))


def part_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where parts begin in the UTF-8 bytes of texts that stand behind each other and begin at `begins`."""
    starts = np.zeros(len(data) + 1, bool)
    gaps = np.flatnonzero((data[:-1] == _SPACE) | (data[:-1] == _BREAK))
    after = data[gaps + 1]
    visible = _VISIBLE[after]
    for first, seconds in _UNSURE.items():
        at = np.flatnonzero(after == first)
        visible[at] = ~_table(seconds)[data[np.minimum(gaps[at] + 2, len(data) - 1)]]
    starts[gaps[visible]] = True
    last = begins[begins > 0] - 1  # a text's last byte has nothing behind it
    starts[last] = False
    ends = np.zeros(len(data), bool)  # bytes with a space, a line break or nothing behind them
    ends[gaps] = True
    ends[:-1] = ends[1:]
    ends[-1:] = True
    ends[last] = True
    marks = np.flatnonzero(ends & _MARK[data])
    starts[marks[_WORD[data[marks - 1]]]] = True  # the first byte of all is a beginning in any case
    starts[begins] = True
    return np.flatnonzero(starts[:-1])


def _values(column: pa.LargeBinaryArray) -> list[bytes]:
    """Values of a whole array without nulls; faster than to_pylist."""
    _, offsets, data = column.buffers()
    at, blob = np.frombuffer(offsets, np.int64, len(column) + 1).tolist(), data.to_pybytes()
    return [blob[a:b] for a, b in zip(at, at[1:])]


def _spaced(column: pa.LargeBinaryArray) -> np.ndarray:
    """Whether a part begins with a space or a line break and a character that is visible for sure; no part is empty."""
    _, offsets, data = column.buffers()
    data, at = np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64, len(column) + 1)
    first, second = data[at[:-1]], data[np.minimum(at[:-1] + 1, at[-1] - 1)]
    return ((first == _SPACE) | (first == _BREAK)) & _VISIBLE[second] & (np.diff(at) > 1)


class PartEncoder:
    """encode_many(list of str) gives the ids of each as little-endian unsigned 32-bit integers.

    encode_spaced does the same for UTF-8 parts that begin with a space or a line break and a visible character, if
    there is a faster way for these. Remembered parts live in two generations of about `limit` parts each: when the
    young one is full it becomes the old one, and parts met again move back to the young one.
    """

    def __init__(
        self,
        encode_many: Callable[[list[str]], Iterable[bytes]],
        limit: int = 350_000,
        encode_spaced: Callable[[list[bytes]], Iterable[bytes]] | None = None,
    ):
        self._encode_many, self._encode_spaced, self._limit = encode_many, encode_spaced, limit
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _learn(self, parts: list[bytes], spaced: np.ndarray) -> list[bytes]:
        """Ids of parts that the young generation hasn't; `spaced` tells the parts for encode_spaced."""
        found = list(map(self._old.get, parts))
        new = np.array([ids is None for ids in found], bool)
        joined = new & spaced if self._encode_spaced else np.zeros(len(parts), bool)
        for some, encode in ((joined, self._encode_spaced), (new & ~joined, self._encode_apart)):
            if some.any():
                at = np.flatnonzero(some).tolist()
                for i, ids in zip(at, encode([parts[i] for i in at])):
                    found[i] = ids
        self._young.update(zip(parts, found))
        return found

    def _encode_apart(self, parts: list[bytes]) -> Iterable[bytes]:
        return self._encode_many([part.decode() for part in parts])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts behind each other, where each text's begin and the last one's end); no text is null."""
        if not len(column):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        begins = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[begins[0] : begins[-1]]
        begins -= begins[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
        starts = part_starts(data, begins)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        distinct, which = _values(coded.dictionary), coded.indices.to_numpy()
        found = list(map(self._young.get, distinct))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            learnt = self._learn([distinct[i] for i in gaps], _spaced(coded.dictionary)[gaps])
            for i, ids in zip(gaps, learnt):
                found[i] = ids
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        upto = np.concatenate(([0], np.cumsum(sizes[which])))
        first, ids = np.cumsum(sizes) - sizes, np.empty(upto[-1], "<u4")
        for a in range(0, len(which), BLOCK):
            some = which[a : a + BLOCK]
            at = upto[a : a + len(some) + 1]
            ids[at[0] : at[-1]] = flat[np.repeat(first[some] - at[:-1], sizes[some]) + np.arange(at[0], at[-1])]
        if np.diff(begins).max() > 16 * self._limit:  # one text may hold very long parts
            self._young, self._old = {}, {}
        return ids, upto[np.searchsorted(starts, begins)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        blob, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [blob[a:b] for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[tuple, PartEncoder] = {}


def shared(key: tuple, make: Callable[[], PartEncoder]) -> PartEncoder:
    """One encoder for each key and Python worker, so that tasks after the first find it filled."""
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def release() -> None:
    """Let go of the encoders of this Python worker: said by operators that need none, as workers outlive a stage
    and would hold what it remembers beside the data of the next."""
    _ENCODERS.clear()


def tokenizers_encoder(model_json: str, limit: int = 350_000) -> PartEncoder:
    """Encoder by the tokenizers library; strings of special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model_json)
    tokenizer.encode_special_tokens = True
    # In a byte-level vocabulary a token has one character for each byte.
    widths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, number in tokenizer.get_vocab().items():
        widths[number] = len(token)

    def encode_many(parts: list[str]):
        for i in range(0, len(parts), 4096):
            for e in tokenizer.encode_batch_fast(parts[i : i + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def encode_spaced(parts: list[bytes]):
        """Parts joined to one text, whose ids fall apart at the bytes where the parts do."""
        for i in range(0, len(parts), 1024):
            some = parts[i : i + 1024]
            ids = np.array(tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum(widths[ids])
            ends = np.cumsum([len(part) for part in some])
            at = np.searchsorted(upto, ends)
            if not len(ids) or at[-1] >= len(upto) or (upto[at] != ends).any():
                raise ValueError("the ids of joined parts don't end where the parts do")
            blob, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            yield from (blob[a:b] for a, b in zip(cuts, cuts[1:]))

    return PartEncoder(encode_many, limit, encode_spaced)
