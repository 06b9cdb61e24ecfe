"""Checksums, integer and text codecs, compression.

Expressions over BINARY columns where SQL can say it; Arrow-batched kernels for arbitrary-precision radixes and compressed
streams. A strict function raises on bad data, its ``try_`` form gives NULL. NULL in gives NULL out.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(text) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def byte_values(data) -> Column:
    """The bytes of a BINARY column as an array of integers."""
    data = F.col(data) if isinstance(data, str) else data
    chars = F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))


# Cyclic redundancy checks, defined as in the catalogue of parametrised CRC algorithms.

#: name: (bits, polynomial in normal form, start, reflected, final exclusive-or). Fixed values.
CRCS = {
    "crc32": (32, 0x04C11DB7, 0xFFFFFFFF, True, 0xFFFFFFFF),
    "crc32c": (32, 0x1EDC6F41, 0xFFFFFFFF, True, 0xFFFFFFFF),
    "crc16_ccitt": (16, 0x1021, 0xFFFF, False, 0),
}


def _mirror(v: int, bits: int) -> int:
    return int(f"{v:0{bits}b}"[::-1], 2)


def crc_table(bits: int, polynomial: int, reflected: bool) -> list[int]:
    """What each byte value adds, by the rule of the polynomial."""
    out = []
    for byte in range(256):
        if reflected:
            v, low = byte, _mirror(polynomial, bits)
            for _ in range(8):
                v = v >> 1 ^ (low if v & 1 else 0)
        else:
            v = byte << (bits - 8)
            for _ in range(8):
                v = (v << 1 ^ (polynomial if v >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(v)
    return out


def crc(data, bits: int, polynomial: int, start: int, reflected: bool, final: int) -> Column:
    """A CRC of 8 to 62 bits as a fold over the bytes."""
    if not 8 <= bits <= 62:
        raise ValueError("a CRC here has from 8 to 62 bits")
    table = F.array(*(F.lit(v).cast("long") for v in crc_table(bits, polynomial, reflected)))

    def step(acc: Column, byte: Column) -> Column:
        byte = byte.cast("long")
        if reflected:
            at = acc.bitwiseXOR(byte).bitwiseAND(F.lit(255).cast("long"))
            return F.shiftrightunsigned(acc, 8).bitwiseXOR(F.get(table, at.cast("int")))
        at = F.shiftrightunsigned(acc, bits - 8).bitwiseXOR(byte).bitwiseAND(F.lit(255).cast("long"))
        return F.shiftleft(acc, 8).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).bitwiseXOR(F.get(table, at.cast("int")))

    return F.aggregate(byte_values(data), F.lit(start).cast("long"), step, lambda acc: acc.bitwiseXOR(F.lit(final).cast("long")))


def crc_named(data, name: str) -> Column:
    return F.crc32(F.col(data) if isinstance(data, str) else data) if name == "crc32" else crc(data, *CRCS[name])


@functools.cache
def largest_prime_below(n: int) -> int:
    return next(p for p in range(n - 1, 1, -1) if all(p % d for d in range(2, int(p**0.5) + 1)))


def _adler(data: bytes, bits: int) -> int:
    """Both running sums in closed form, over pieces that 64 bits hold."""
    if bits == 32:
        return zlib.adler32(data)
    prime, a, b = largest_prime_below(1 << (bits // 2)), 1, 0
    for lo in range(0, len(data), 1 << 20):
        part = np.frombuffer(data, np.uint8, min(1 << 20, len(data) - lo), lo).astype(np.int64)
        b = (b + len(part) * a + int((part * np.arange(len(part), 0, -1)).sum())) % prime
        a = (a + int(part.sum())) % prime
    return b << (bits // 2) | a


def adler(data, bits: int = 32) -> Column:
    """The Adler checksum of 16, 32 or 64 bits: two running sums modulo the largest prime that fits half the bits; as a LONG."""
    if bits not in (16, 32, 64):
        raise ValueError("an Adler checksum has 16, 32 or 64 bits")

    @F.pandas_udf("long")
    def sums(values: pd.Series) -> pd.Series:
        found = [None if x is None else _adler(bytes(x), bits) for x in values]
        return pd.Series([x if x is None or x < 1 << 63 else x - (1 << 64) for x in found], dtype="Int64")

    return sums(F.col(data) if isinstance(data, str) else data)


# Integers.


def zigzag_encode(v) -> Column:
    v = (F.col(v) if isinstance(v, str) else v).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def zigzag_decode(v) -> Column:
    v = (F.col(v) if isinstance(v, str) else v).cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast("long")))


def varint_encode(v) -> Column:
    """LEB128 of the 64-bit pattern: seven bits a byte, low first, the high bit set on all but the last byte."""
    v = (F.col(v) if isinstance(v, str) else v).cast("long")
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftrightunsigned", v, i * 7))
    used = F.greatest(F.lit(1), F.size(F.filter(groups, lambda g: g != 0)))
    parts = F.transform(F.slice(groups, 1, used), lambda g, i: F.lpad(F.hex(g.bitwiseAND(F.lit(127).cast("long")) + F.when(i < used - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(parts, ""))


def try_varint_decode(data) -> Column:
    """The LONG of one LEB128 value; NULL if it is cut off, goes on behind its end, or has more than 64 bits."""
    values = byte_values(data)
    n = F.size(values)
    fold = F.aggregate(values, F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("shift")), lambda acc, b: F.struct(acc["v"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(F.lit(127)).cast("long"), acc["shift"])).alias("v"), (acc["shift"] + 7).alias("shift")), lambda acc: acc["v"])
    open_bytes = F.size(F.filter(values, lambda b: b >= 128))
    fits = (n < 10) | ((n == 10) & (F.get(values, F.lit(9)) <= 1))
    return F.when((n > 0) & fits & (open_bytes == n - 1) & (F.element_at(values, -1) < 128), fold)


def varint_decode(data) -> Column:
    out = try_varint_decode(data)
    return F.when((F.col(data) if isinstance(data, str) else data).isNull() | out.isNotNull(), out).otherwise(F.raise_error(F.lit("not one LEB128 value of 64 bits")).cast("long"))


# Text alphabets. Fixed values, in the order of RFC 4648 and of common use.

BASE16 = "0123456789ABCDEF"
BASE16_LOWER = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE64URL = BASE64[:-2] + "-_"


def to_base16(data, upper: bool = True) -> Column:
    out = F.hex(F.col(data) if isinstance(data, str) else data)
    return out if upper else F.lower(out)


def to_base64(data) -> Column:
    """On one line, padded."""
    return F.regexp_replace(F.base64(F.col(data) if isinstance(data, str) else data), "[\r\n]", "")


def to_base64url(data) -> Column:
    return F.translate(to_base64(data), "+/", "-_")


def to_base32(data, padding: bool = True) -> Column:
    """Five bits a character, from groups of five bytes."""
    data = F.col(data) if isinstance(data, str) else data
    values = byte_values(data)
    n = F.size(values)
    chars = F.floor((n * 8 + 4) / 5).cast("int")

    def char(i: Column) -> Column:
        bit = i * 5
        byte = F.floor(bit / 8).cast("int")
        pair = F.shiftleft(F.get(values, byte), 8).bitwiseOR(F.coalesce(F.get(values, byte + 1), F.lit(0)))
        return F.substring(F.lit(BASE32), F.call_function("shiftright", pair, F.lit(11) - bit % 8).bitwiseAND(F.lit(31)) + 1, F.lit(1))

    body = F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(chars, F.lit(1)) - 1), char), ""))
    return F.when(data.isNull(), F.lit(None)).otherwise(F.rpad(body, F.ceil(chars / 8).cast("int") * 8, "=") if padding else body)


def encode_radix(data: bytes, alphabet: str) -> str:
    """Any radix: the bytes as one number; each leading zero byte is a leading first letter."""
    zeros = len(data) - len(data.lstrip(b"\0"))
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, digit = divmod(n, len(alphabet))
        out.append(alphabet[digit])
    return alphabet[0] * zeros + "".join(reversed(out))


def decode_radix(text: str, alphabet: str) -> bytes:
    zeros, n = len(text) - len(text.lstrip(alphabet[0])), 0
    for c in text:
        digit = alphabet.find(c)
        if digit < 0:
            raise ValueError(f"{c!r} is not of the alphabet")
        n = n * len(alphabet) + digit
    return bytes(zeros) + n.to_bytes(-(-n.bit_length() // 8), "big")


def decode_bits(text: str, alphabet: str, padding: str = "allow", ignore_case: bool = False, skip_space: bool = False) -> bytes:
    """An alphabet of a power of two, with ``padding`` to "require", "allow" or "reject". Bits left over must be zero."""
    if padding not in ("require", "allow", "reject"):
        raise ValueError("padding is one of require, allow and reject")
    width = len(alphabet).bit_length() - 1
    group = {1: 8, 2: 4, 3: 8, 4: 2, 5: 8, 6: 4}[width]
    if skip_space:
        text = "".join(text.split())
    body = text.rstrip("=")
    pads = len(text) - len(body)
    if pads and padding == "reject" or padding == "require" and len(text) % group or pads and (len(text) % group or pads >= group):
        raise ValueError("bad padding")
    if ignore_case:
        body = body.upper() if alphabet == alphabet.upper() else body.lower()
    n = 0
    for c in body:
        digit = alphabet.find(c)
        if digit < 0:
            raise ValueError(f"{c!r} is not of the alphabet")
        n = n << width | digit
    bits = len(body) * width
    extra = bits % 8
    if extra >= width or n & ((1 << extra) - 1):
        raise ValueError("bits are left over")
    return (n >> extra).to_bytes(bits // 8, "big")


#: What a kernel takes at once, in bytes of its columns. A row is never split.
PIECE = 1 << 20
_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def _pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of an Arrow batch in pieces of ``PIECE`` bytes at most, or of one row."""
    n = len(columns[0])
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield tuple(c.slice(at, to - at) for c in columns)
        at = to
    if not n:
        yield columns


def kernels(functions: dict[str, Callable], returns: str, strict: bool) -> Callable[..., Column]:
    """Value functions as a struct, one of each name: over a column, or each over a column of its own. Without ``strict``, bad data gives NULL.

    All run in one Python worker, and what they give leaves it in pieces; a worker holds one batch of what comes in."""

    def value(function: Callable, x):
        if x is None:
            return None
        try:
            return function(x)
        except (ValueError, zlib.error, struct.error, EOFError):
            if strict:
                raise
            return None

    def run(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        for piece in _pieces(columns):
            own = piece if len(piece) == len(functions) else piece * len(functions)
            yield pa.StructArray.from_arrays([pa.array([value(f, x.as_py()) for x in c], _ARROW[returns]) for f, c in zip(functions.values(), own, strict=True)], list(functions))

    schema = ", ".join(f"`{name}` {returns}" for name in functions)

    def over(*columns) -> Column:
        if len(columns) not in (1, len(functions)):
            raise ValueError("one column, or one a function")
        if len(columns) == 1:

            @F.arrow_udf(schema)
            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in batches:
                    yield from run((batch,))

            return one(*columns)

        @F.arrow_udf(schema)
        def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield from run(batch)

        return each(*columns)

    return over


def kernel(function: Callable, returns: str, strict: bool) -> Callable[[Column], Column]:
    """A value function over a column; without ``strict``, bad data gives NULL."""
    return lambda column: kernels({"value": function}, returns, strict)(column)["value"]


def to_radix(data, alphabet: str) -> Column:
    return kernel(lambda x: encode_radix(x, alphabet), "string", True)(data)


def from_radix(text, alphabet: str, strict: bool = True) -> Column:
    return kernel(lambda x: decode_radix(x, alphabet), "binary", strict)(text)


def from_base(text, alphabet: str, strict: bool = True, **options) -> Column:
    return kernel(lambda x: decode_bits(x, alphabet, **options), "binary", strict)(text)


def encoded_size(n, alphabet: str, padding: bool = True) -> Column:
    """Characters that a power-of-two alphabet needs for n bytes."""
    n = F.col(n) if isinstance(n, str) else n
    width = len(alphabet).bit_length() - 1
    group = {4: 2, 5: 8, 6: 4}[width]
    chars = F.ceil(n * 8 / width)
    return (F.ceil(chars / group) * group if padding else chars).cast("long")


def decoded_size(chars, alphabet: str) -> Column:
    """Bytes that so many characters, without padding, stand for."""
    chars = F.col(chars) if isinstance(chars, str) else chars
    return F.floor(chars * (len(alphabet).bit_length() - 1) / 8).cast("long")


# Byte strings.


def to_hex(data, upper: bool = False, separator: str = "") -> Column:
    out = to_base16(data, upper)
    return F.regexp_replace(out, "(..)(?=.)", f"$1{separator}") if separator else out


def from_hex(text) -> Column:
    """Characters that aren't hexadecimal digits are left out; an odd number of digits raises."""
    digits = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) % 2 == 0, F.unhex(digits)).otherwise(F.raise_error(F.lit("an odd number of hexadecimal digits")).cast("binary"))


def find_bytes(data, part, start: int = 0) -> Column:
    """The first position from ``start`` at which ``part`` begins, from 0; NULL where it doesn't occur."""
    latin = lambda x: F.decode(F.col(x) if isinstance(x, str) else x, "ISO-8859-1")
    at = F.call_function("locate", latin(part), latin(data), F.lit(start + 1))
    return F.nullif(at, F.lit(0)) - 1


def rfind_bytes(data, part) -> Column:
    """The last position at which ``part`` begins."""
    latin = lambda x: F.decode(F.col(x) if isinstance(x, str) else x, "ISO-8859-1")
    at = F.call_function("locate", F.reverse(latin(part)), F.reverse(latin(data)), F.lit(1))
    return F.when(at > 0, F.octet_length(data) - (at - 1) - F.octet_length(part))


def count_bytes(data, part) -> Column:
    """How often ``part`` occurs without overlap."""
    latin = lambda x: F.decode(F.col(x) if isinstance(x, str) else x, "ISO-8859-1")
    size = F.length(latin(part))
    return F.when(size > 0, ((F.length(latin(data)) - F.length(F.replace(latin(data), latin(part), F.lit("")))) / size).cast("long"))


def contains_bytes(data, part) -> Column:
    return find_bytes(data, part).isNotNull()


def sub_bytes(data, start: int, size: int) -> Column:
    return F.substring(F.col(data) if isinstance(data, str) else data, start + 1, size)


#: Formats of the struct module for the fixed-width types of a flat buffer, all little-endian. Fixed values.
FIELD_FORMATS = {"bool": "?", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float": "f", "double": "d"}
_CODECS: dict[str, tuple[Callable, Callable]] = {}


def register_codec(kind: str, write: Callable[[object], bytes], read: Callable[[bytes, int], tuple[object, int]]) -> None:
    """A user's field type: bytes of a value, and a value with the position behind it."""
    _CODECS[kind] = (write, read)


def write_fields(values, kinds: list[str]) -> bytes:
    """Typed fields in a row; strings and bytes after their length in 32 bits."""
    out = []
    for value, kind in zip(values, kinds, strict=True):
        if kind in FIELD_FORMATS:
            out.append(struct.pack("<" + FIELD_FORMATS[kind], value))
        elif kind in ("string", "bytes"):
            raw = value.encode() if kind == "string" else bytes(value)
            out.append(struct.pack("<I", len(raw)) + raw)
        else:
            out.append(_CODECS[kind][0](value))
    return b"".join(out)


def read_fields(data: bytes, kinds: list[str], at: int = 0) -> list:
    out = []
    for kind in kinds:
        if kind in FIELD_FORMATS:
            form = "<" + FIELD_FORMATS[kind]
            out.append(struct.unpack_from(form, data, at)[0])
            at += struct.calcsize(form)
        elif kind in ("string", "bytes"):
            (size,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + size]
            if len(raw) < size:
                raise ValueError("the data ends within a field")
            out.append(raw.decode() if kind == "string" else raw)
            at += 4 + size
        else:
            value, at = _CODECS[kind][1](data, at)
            out.append(value)
    return out


def pack_fields(columns: list[str], kinds: list[str]) -> Column:
    """Columns as one BINARY flat buffer."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write_fields(row, kinds) for row in zip(*batch, strict=True)], dtype=object)

    return run(*columns)


def unpack_fields(data, kinds: list[str], schema: str) -> Column:
    """A flat buffer as a struct of ``schema``."""
    names = [x.split()[0] for x in schema.split(",")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_fields(bytes(x), kinds) for x in batch], columns=names)

    return run(data)


# Compressed streams.

_WINDOW_BITS = {"raw": -15, "zlib": 15, "gzip": 31}


def deflater(container: str = "zlib", level: int = 6, strategy: str = "auto") -> Callable[[bytes], bytes]:
    if container not in _WINDOW_BITS or strategy not in ("stored", "fixed", "dynamic", "auto"):
        raise ValueError("unknown container or strategy")
    if strategy == "auto":
        strategy = "stored" if level == 0 else "fixed" if level <= 3 else "dynamic"
    level, how = (0, zlib.Z_DEFAULT_STRATEGY) if strategy == "stored" else (max(1, level), zlib.Z_FIXED if strategy == "fixed" else zlib.Z_DEFAULT_STRATEGY)

    def value(x: bytes) -> bytes:
        packer = zlib.compressobj(level, zlib.DEFLATED, _WINDOW_BITS[container], 9, how)
        return packer.compress(x) + packer.flush()

    return value


def inflater(container: str | None = None) -> Callable[[bytes], bytes]:
    def value(x: bytes) -> bytes:
        unpacker = zlib.decompressobj(_WINDOW_BITS[container or container_of(x)])
        out = unpacker.decompress(x) + unpacker.flush()
        if not unpacker.eof:
            raise ValueError("the stream is cut off")
        return out

    return value


def deflate(data, container: str = "zlib", level: int = 6, strategy: str = "auto") -> Column:
    """A DEFLATE stream in a container. ``strategy``: "stored", "fixed", "dynamic", or "auto" by level (0 stored, to 3 fixed)."""
    return kernel(deflater(container, level, strategy), "binary", True)(data)


def inflate(data, container: str | None = None, strict: bool = True) -> Column:
    """The bytes of a DEFLATE stream; checksums are verified. Without a container, it is detected."""
    return kernel(inflater(container), "binary", strict)(data)


def container_of(x: bytes) -> str:
    if x[:2] == b"\x1f\x8b":
        return "gzip"
    return "zlib" if len(x) >= 2 and x[0] & 15 == 8 and x[0] >> 4 <= 7 and (x[0] << 8 | x[1]) % 31 == 0 else "raw"


def detect_container(data) -> Column:
    """gzip by its magic, else zlib by its header's check, else raw: an expression over two bytes."""
    data = F.col(data) if isinstance(data, str) else data
    head = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    cm = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    return F.when(head == 0x1F8B, F.lit("gzip")).when((F.octet_length(data) >= 2) & (cm % 16 == 8) & (cm < 128) & (head % 31 == 0), F.lit("zlib")).otherwise(F.lit("raw"))


def valid_zlib_header(data) -> Column:
    return detect_container(data) == "zlib"


def valid_gzip_header(data) -> Column:
    data = F.col(data) if isinstance(data, str) else data
    return (F.octet_length(data) >= 10) & (F.hex(F.substring(data, 1, 3)) == "1F8B08")


def compress_bound(n) -> Column:
    """Bytes that a stream of n stored bytes takes at most in any container: five a block of 65535, and 18 around."""
    n = F.col(n) if isinstance(n, str) else n
    return (n + F.greatest(F.ceil(n / 65535), F.lit(1)) * 5 + 18).cast("long")


def gzip_member(data: bytes, name: str = "", comment: str = "", mtime: int = 0, os: int = 255, text: bool = False, header_crc: bool = False, level: int = 6) -> bytes:
    """A gzip member with metadata in its header."""
    flags = text * 1 | header_crc * 2 | bool(name) * 8 | bool(comment) * 16
    head = struct.pack("<2sBBIBB", b"\x1f\x8b", 8, flags, mtime, 0, os) + b"".join(x.encode("latin-1") + b"\0" for x in (name, comment) if x)
    if header_crc:
        head += struct.pack("<H", zlib.crc32(head) & 0xFFFF)
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return head + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gzip_header(data: bytes) -> tuple:
    """``(name, comment, mtime, os, text, header_crc)`` of a gzip member."""
    magic, method, flags, mtime, _, os = struct.unpack_from("<2sBBIBB", data)
    if magic != b"\x1f\x8b" or method != 8:
        raise ValueError("not a gzip member")
    at, texts = 10, []
    if flags & 4:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    for bit in (8, 16):
        if flags & bit:
            end = data.index(b"\0", at)
            texts.append(data[at:end].decode("latin-1"))
            at = end + 1
        else:
            texts.append("")
    if flags & 2 and struct.unpack_from("<H", data, at)[0] != zlib.crc32(data[:at]) & 0xFFFF:
        raise ValueError("the header's checksum is wrong")
    return (*texts, mtime, os, bool(flags & 1), bool(flags & 2))


def gzip_info(data, strict: bool = True) -> Column:
    schema = "struct<name:string,comment:string,mtime:long,os:int,text:boolean,header_crc:boolean>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch:
                try:
                    rows.append(gzip_header(bytes(x)) if x is not None else (None,) * 6)
                except (ValueError, struct.error):
                    if strict:
                        raise
                    rows.append((None,) * 6)
            yield pd.DataFrame(rows, columns=["name", "comment", "mtime", "os", "text", "header_crc"])

    return run(data)
