"""Bit operations as column expressions.

Integers are LONG columns read as unsigned values of a stated width, at most 64 bits. Everything here is built-in
arithmetic, so it stays inside generated code; NULL in gives NULL out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class BitOrder(Enum):
    """How fields are packed into bytes.

    LSBYTE fills each byte from its low bit, MSBYTE from its high bit. LSBIT and MSBIT are the same with the bits of every byte
    reversed on the way in and out."""

    LSBYTE = "lsbyte"
    MSBYTE = "msbyte"
    LSBIT = "lsbit"
    MSBIT = "msbit"


def _width(width: int, most: int = 64) -> int:
    if not 1 <= width <= most:
        raise ValueError(f"the width must be from 1 to {most} bits, not {width}")
    return width


def mask(width: int) -> int:
    """The signed LONG with the low ``width`` bits set."""
    return -1 if _width(width) == 64 else (1 << width) - 1


def _long(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("long")


def low_bits(v, width: int) -> Column:
    return _long(v).bitwiseAND(F.lit(mask(width)).cast("long"))


def reverse_bits(v, width: int = 64) -> Column:
    """The low ``width`` bits in reverse order: swaps of ever larger halves of 64 bits, then a shift down."""
    v = low_bits(v, width)
    for shift, keep in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        keep = F.lit(keep).cast("long")
        v = F.shiftleft(v.bitwiseAND(keep), shift).bitwiseOR(F.shiftrightunsigned(v, shift).bitwiseAND(keep))
    return F.shiftrightunsigned(v, 64 - width) if width < 64 else v


def popcount(v, width: int = 64) -> Column:
    return F.bit_count(low_bits(v, width))


def rotate_left(v, shift, width: int = 64) -> Column:
    """Rotation modulo the width; a negative shift goes the other way."""
    v = low_bits(v, width)
    s = F.pmod(_long(shift) if not isinstance(shift, int) else F.lit(shift).cast("long"), F.lit(width).cast("long")).cast("int")
    rotated = F.call_function("shiftleft", v, s).bitwiseOR(F.call_function("shiftrightunsigned", v, F.lit(width) - s))
    return F.when(s == 0, v).otherwise(low_bits(rotated, width))


def rotate_right(v, shift, width: int = 64) -> Column:
    return rotate_left(v, -shift if isinstance(shift, int) else -_long(shift), width)


def clear_lowest_bit(v) -> Column:
    v = _long(v)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(v.bitwiseAND(F.expr("-1L") + v))


def extract_bits(v, start: int, count: int) -> Column:
    """``count`` bits from bit ``start`` on, moved to the low end."""
    _width(start + count)
    return F.shiftrightunsigned(_long(v), start).bitwiseAND(F.lit(mask(count)).cast("long"))


def _smear(v: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift))
    return v


def bit_floor(v) -> Column:
    """The greatest power of two up to v; 0 for 0."""
    smeared = _smear(_long(v))
    return smeared - F.shiftrightunsigned(smeared, 1)


def bit_ceil(v) -> Column:
    """The least power of two from v on; 1 for 0."""
    v = _long(v)
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(_smear(v - 1) + 1)


def field_get(v, offset: int, count: int) -> Column:
    return extract_bits(v, offset, count)


def field_set(v, offset: int, count: int, value) -> Column:
    """v with ``count`` bits from ``offset`` on replaced by the low bits of ``value``."""
    _width(offset + count)
    hole = ~(mask(count) << offset) & 0xFFFFFFFFFFFFFFFF
    hole = hole - (1 << 64) if hole >> 63 else hole
    return _long(v).bitwiseAND(F.lit(hole).cast("long")).bitwiseOR(F.shiftleft(low_bits(value, count), offset))


def bit_at(v, i) -> Column:
    """Bit i as 0 or 1."""
    return F.call_function("getbit", _long(v), i if isinstance(i, Column) else F.lit(i))


def bits_of(v, width: int = 64) -> Column:
    """All bits, the lowest first, as an array; explode it to walk them."""
    v = _long(v)
    return F.transform(F.sequence(F.lit(0), F.lit(_width(width) - 1)), lambda i: F.call_function("getbit", v, i))


def reverse_bytes(v, size: int = 8) -> Column:
    """The low ``size`` bytes in reverse order; with big- or little-endian data on the other side, the conversion between the two."""
    _width(8 * size)
    v = low_bits(v, 8 * size)
    out = F.lit(0).cast("long")
    for i in range(size):
        out = out.bitwiseOR(F.shiftleft(extract_bits(v, 8 * i, 8), 8 * (size - 1 - i)))
    return out


# Flags: a set of named bits in one mask.


def flags_add(flags, more) -> Column:
    return _long(flags).bitwiseOR(_long(more))


def flags_remove(flags, less) -> Column:
    return _long(flags).bitwiseAND(F.bitwise_not(_long(less)))


def flags_contain(flags, some) -> Column:
    """Whether any of the given bits is set."""
    return _long(flags).bitwiseAND(_long(some)) != 0


def flags_list(flags) -> Column:
    """The single-bit masks of all set bits, ascending."""
    v = _long(flags)
    masks = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.filter(masks, lambda m: v.bitwiseAND(m) != 0)


# Bit sets of any length, as arrays of booleans.


def bitset(size: int, positions: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(positions, i))


def bitset_test(bits: Column, i) -> Column:
    return F.get(bits, F.lit(i) if isinstance(i, int) else i)


def bitset_set(bits: Column, i: int, value: bool = True) -> Column:
    return F.transform(bits, lambda x, k: F.when(k == i, F.lit(value)).otherwise(x))


def bitset_flip(bits: Column, i: int | None = None) -> Column:
    return F.transform(bits, lambda x, k: ~x if i is None else F.when(k == i, ~x).otherwise(x))


def bitset_resize(bits: Column, size: int) -> Column:
    """Cut, or grown by unset bits. Here and below an operand stands outside of lambdas, which would work it out anew for each bit."""
    return F.transform(F.slice(F.concat(bits, F.array_repeat(F.lit(False), size)), 1, size), lambda x: F.coalesce(x, F.lit(False)))


def _bitwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """The left length; what the right set lacks counts as unset."""
    pairs = F.zip_with(F.transform(a, lambda x: F.struct(x.alias("x"))), b, lambda s, y: F.struct(s.isNotNull().alias("own"), f(s["x"], F.coalesce(y, F.lit(False))).alias("z")))
    return F.transform(F.filter(pairs, lambda p: p["own"]), lambda p: p["z"])


def bitset_and(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: x & y)


def bitset_or(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: x | y)


def bitset_xor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, lambda x, y: x != y)


def bitset_count(bits: Column) -> Column:
    return F.size(F.filter(bits, lambda x: x))


# Packing by a cursor that walks over bytes. Layouts with fixed widths need no cursor: extract_bits has them.

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _turned(data: bytes, order: BitOrder) -> bytes:
    return data.translate(_REVERSED) if order in (BitOrder.LSBIT, BitOrder.MSBIT) else data


def read_bits(data: bytes, widths: Sequence[int], order: BitOrder, start: int = 0) -> list[int]:
    """Consecutive fields of the given widths from bit ``start`` on; ValueError where the data ends before."""
    if start + sum(widths) > 8 * len(data):
        raise ValueError("the data ends before the last field")
    data, out = _turned(data, order), []
    low_first = order in (BitOrder.LSBYTE, BitOrder.LSBIT)
    whole, total = int.from_bytes(data, "little" if low_first else "big"), 8 * len(data)
    for width in widths:
        shift = start if low_first else total - start - width
        out.append(whole >> shift & ((1 << width) - 1))
        start += width
    return out


def write_bits(values: Sequence[int], widths: Sequence[int], order: BitOrder) -> bytes:
    """Consecutive fields, the last byte filled up with zero bits."""
    low_first, whole, at = order in (BitOrder.LSBYTE, BitOrder.LSBIT), 0, 0
    for value, width in zip(values, widths, strict=True):
        value &= (1 << width) - 1
        whole = whole | value << at if low_first else whole << width | value
        at += width
    size = -(-at // 8)
    if not low_first:
        whole <<= 8 * size - at
    return _turned(whole.to_bytes(size, "little" if low_first else "big"), order)


def _overlaps(widths: Sequence[int], order: BitOrder) -> Iterator[tuple[int, int, int, int, int]]:
    """``(byte, field, mask, place in the byte, place in the field)`` of what each field has in each byte, before bits are turned."""
    start, low_first = 0, order in (BitOrder.LSBYTE, BitOrder.LSBIT)
    for field, width in enumerate(widths):
        for byte in range(start // 8, -(-(start + _width(width)) // 8)):
            low, high = max(start, 8 * byte), min(start + width, 8 * byte + 8)
            yield byte, field, (1 << high - low) - 1, low - 8 * byte if low_first else 8 * byte + 8 - high, low - start if low_first else start + width - high
        start += width


def _turned_array(data: np.ndarray, order: BitOrder) -> np.ndarray:
    return np.frombuffer(_REVERSED, np.uint8)[data] if order in (BitOrder.LSBIT, BitOrder.MSBIT) else data


def unpack_array(data: pa.Array, widths: Sequence[int], order: BitOrder, strict: bool) -> pa.Array:
    """``read_bits`` of all rows at once, byte by byte."""
    data = data.cast(pa.large_binary())
    _, ends, held = data.buffers()
    ends = np.frombuffer(ends, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    there, size = ~data.is_null().to_numpy(zero_copy_only=False), -(-sum(widths) // 8)
    enough = there & (np.diff(ends) >= size)
    if strict and (enough != there).any():
        raise ValueError("the data ends before the last field")
    flat = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    raw = _turned_array(flat[ends[:-1][enough][:, None] + np.arange(size)], order)
    out = np.zeros((len(raw), len(widths)), np.uint64)
    for byte, field, bits, place, within in _overlaps(widths, order):
        out[:, field] |= (raw[:, byte].astype(np.uint64) >> np.uint64(place) & np.uint64(bits)) << np.uint64(within)
    starts = np.concatenate([[0], np.cumsum(enough * len(widths))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(out.view(np.int64).ravel()), mask=pa.array(~enough))


def pack_array(fields: pa.Array, widths: Sequence[int], order: BitOrder) -> pa.Array:
    """``write_bits`` of all rows at once, byte by byte."""
    there = ~fields.is_null().to_numpy(zero_copy_only=False)
    given = fields.drop_null()
    values = given.flatten()
    if values.null_count or (pc.list_value_length(given).to_numpy(zero_copy_only=False) != len(widths)).any():
        raise ValueError("not one value a field")
    values = values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(given), len(widths))
    raw = np.zeros((len(fields), -(-sum(widths) // 8)), np.uint8)
    for byte, field, bits, place, within in _overlaps(widths, order):
        raw[there, byte] |= ((values[:, field] >> np.uint64(within) & np.uint64(bits)) << np.uint64(place)).astype(np.uint8)
    raw = _turned_array(raw, order)
    kept = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(raw.shape[1]), len(raw), [kept, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def unpack_bits(data: Column, widths: Sequence[int], order: BitOrder = BitOrder.LSBYTE, strict: bool = True) -> Column:
    """Fields of a binary column, of up to 64 bits each, as an array of LONG; too short data raises, or is NULL if not strict."""
    widths = [_width(w) for w in widths]

    @F.arrow_udf("array<long>")
    def run(batch: pa.Array) -> pa.Array:
        return unpack_array(batch, widths, order, strict)

    return run(data)


def pack_bits(fields: Column, widths: Sequence[int], order: BitOrder = BitOrder.LSBYTE) -> Column:
    """An array of LONG fields, of up to 64 bits each, as bytes."""
    widths = [_width(w) for w in widths]

    @F.arrow_udf("binary")
    def run(batch: pa.Array) -> pa.Array:
        return pack_array(batch, widths, order)

    return run(fields)


class BitReader:
    """A cursor over the bits of bytes; reading behind the end raises ValueError."""

    def __init__(self, data: bytes, order: BitOrder = BitOrder.LSBYTE):
        self.data, self.order, self.place = data, order, 0

    @property
    def eof(self) -> bool:
        return self.place >= 8 * len(self.data)

    def peek(self, width: int) -> int:
        first, last = self.place >> 3, -(-(self.place + width) // 8)
        if last > len(self.data):
            raise ValueError("the data ends before the field")
        return read_bits(self.data[first:last], [width], self.order, self.place & 7)[0]

    def read(self, width: int) -> int:
        value = self.peek(width)
        self.place += width
        return value

    def drop(self, width: int) -> None:
        self.seek(self.place + width)

    def seek(self, place: int) -> None:
        if not 0 <= place <= 8 * len(self.data):
            raise ValueError("the data has no such bit")
        self.place = place

    def align(self) -> None:
        """On to the next byte, if within one."""
        self.place = -(-self.place // 8) * 8


class BitWriter:
    """The dual of the reader: fields one behind the other; ``seek`` goes back over what is there, to write it anew."""

    def __init__(self, order: BitOrder = BitOrder.LSBYTE):
        self.order, self.bits, self.place = order, [], 0

    def write(self, value: int, width: int) -> None:
        low_first = self.order in (BitOrder.LSBYTE, BitOrder.LSBIT)
        new = [value >> (i if low_first else width - 1 - i) & 1 for i in range(width)]
        self.bits[self.place : self.place + width] = new
        self.place += width

    def align(self) -> None:
        self.write(0, -self.place % 8)

    def write_bytes(self, data: bytes) -> None:
        if self.place % 8:
            raise ValueError("bytes begin at a byte")
        for byte in data:
            self.write(byte, 8)

    def seek(self, place: int) -> None:
        if not 0 <= place <= len(self.bits):
            raise ValueError("no such bit is written")
        self.place = place

    def buffer(self) -> bytes:
        return write_bits(self.bits, [1] * len(self.bits), self.order)


def by_cursor(columns: list[Column], returns: str, f: Callable[..., object]) -> Column:
    """A function of plain values, such as a walk of a cursor, over columns in Arrow batches; NULL in any gives NULL."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = zip(*((batch,) if isinstance(batch, pd.Series) else batch), strict=True)
            yield pd.Series([None if any(v is None for v in row) else f(*row) for row in rows], dtype=object)

    return run(*columns)
