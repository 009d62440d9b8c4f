"""The 64-bit hash behind portable sketches: FNV-1a over UTF-8 bytes, then a splitmix64 finaliser.

Two forms with equal results. `portable_hash` runs in the JVM on 32-bit halves, because a 64-bit
product that wraps around is an error in Spark SQL. `register_and_rank` is an Arrow function on
whole columns and returns only what a sketch keeps of the hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two public algorithms and of the sketch layout.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MIX_FIRST = 0xBF58476D1CE4E5B9
MIX_SECOND = 0x94D049BB133111EB
PRECISION = 14
REGISTERS = 1 << PRECISION
MAX_RANK = 64 - PRECISION + 1

_LOW = (1 << 32) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _mask(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_LOW))


def _times(value: Column, factor: int) -> Column:
    """value * factor modulo 2^64, from products that stay below 2^63.

    The factor is cut into 16-bit digits; each digit times a 32-bit half fits a long, and the
    shifted sums are kept as separate halves so that no addition overflows either.
    """
    low, high = _mask(value), F.shiftrightunsigned(value, 32)
    total_low, total_high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(4):
        digit = (factor >> (16 * i)) & 0xFFFF
        if not digit:
            continue
        part_low, part_high = low * F.lit(digit), high * F.lit(digit)
        if i < 2:
            shifted = F.shiftleft(part_low, 16 * i) if i else part_low
            total_low = total_low + _mask(shifted)
            carried = F.shiftrightunsigned(part_low, 32 - 16 * i)
            total_high = total_high + carried + (F.shiftleft(_mask(part_high), 16) if i else part_high)
        else:
            total_high = total_high + F.shiftleft(_mask(part_low), 16 * (i - 2))
    total_high = total_high + F.shiftrightunsigned(total_low, 32)
    return _join(_mask(total_high), _mask(total_low))


def _fnv_step(state: Column, byte: Column) -> Column:
    return _times(state.bitwiseXOR(byte), FNV_PRIME)


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string as an array of numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"))
    return F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("long"))


def portable_hash(text: Column) -> Column:
    """The hash as a signed 64-bit number, with built-in expressions only."""
    start = F.lit(_signed(FNV_OFFSET))
    return F.aggregate(_bytes(text), start, _fnv_step, _finish)


def _finish(x: Column) -> Column:
    # Each step sees the previous value once, as the variable of a one-element lambda.
    x = _bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    x = _bind(x, lambda v: _times(v, MIX_FIRST))
    x = _bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    x = _bind(x, lambda v: _times(v, MIX_SECOND))
    return _bind(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def _bind(value: Column, step) -> Column:
    return F.transform(F.array(value), step)[0]


def register_of(hashed: Column) -> Column:
    """Which register a hash belongs to: its top bits."""
    return F.shiftrightunsigned(hashed, 64 - PRECISION).cast("int")


def rank_of(hashed: Column) -> Column:
    """Leading zeros of the remaining bits plus one, at most MAX_RANK."""
    rest = F.shiftleft(hashed, PRECISION)
    zeros = F.when(rest == 0, F.lit(64)).otherwise(F.lit(64) - F.length(F.bin(rest)))
    return F.least(zeros + F.lit(1), F.lit(MAX_RANK)).cast("int")


def _make_register_and_rank():
    # Everything the workers need is local to this function, so it travels with the plan and the
    # package need not be installed on the executors.
    offset_basis, prime = FNV_OFFSET, FNV_PRIME
    first, second, precision, max_rank = MIX_FIRST, MIX_SECOND, PRECISION, MAX_RANK

    @F.arrow_udf("int")
    def register_and_rank(text: pa.Array) -> pa.Array:
        u64 = np.uint64
        column = text.cast(pa.large_binary())
        n = len(column)
        if n == 0:
            return pa.array([], pa.int32())
        _, offset_buffer, data_buffer = column.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        # Longest first: the rows still being hashed are always a prefix.
        order = np.argsort(-lengths, kind="stable")
        starts, ordered = offsets[:-1][order], lengths[order]
        state = np.full(n, offset_basis, u64)
        active = n
        for position in range(int(ordered[0])):
            while active and ordered[active - 1] <= position:
                active -= 1
            head = state[:active]
            head ^= data[starts[:active] + position].astype(u64)
            head *= u64(prime)
        state ^= state >> u64(30)
        state *= u64(first)
        state ^= state >> u64(27)
        state *= u64(second)
        state ^= state >> u64(31)
        rest = state << u64(precision)
        # Leading zeros by halving; exact for every 64-bit value.
        zeros = np.zeros(n, np.int32)
        probe = rest.copy()
        for width in (32, 16, 8, 4, 2, 1):
            clear = probe < u64(1 << (64 - width))
            zeros += np.where(clear, width, 0).astype(np.int32)
            probe = np.where(clear, probe << u64(width), probe)
        zeros = np.where(rest == 0, 64, zeros)
        rank = np.minimum(zeros + 1, max_rank).astype(np.int32)
        packed = ((state >> u64(64 - precision)).astype(np.int32) << 6) | rank
        result = np.empty(n, np.int32)
        result[order] = packed
        mask = np.asarray(text.is_null()) if text.null_count else None
        return pa.array(result, pa.int32(), mask=mask)

    return register_and_rank


def register_and_rank(text: Column) -> Column:
    """Register and rank of a text in one int: register * 64 + rank."""
    return _make_register_and_rank()(text)
