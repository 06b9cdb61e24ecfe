"""What the operators share: written intermediate tables, word splitting and vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Separators of words, as a fixed value of the data contracts.
SEPARATORS = b" \t\n\x0b\x0c\r"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


_own_dirs: dict[str, str] = {}
_app_dirs: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, ``spark.checkpoint.dir`` of the session; it goes when the
    driver's JVM ends.

    Where that is unset, a local session gets a temporary folder, and a cluster, whose executors wouldn't see it, an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        found = _own_dirs[context.applicationId]
    path = f"{found.rstrip('/')}/lodeframe-{context.applicationId}"
    if (context.applicationId, path) not in _app_dirs:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _app_dirs.add((context.applicationId, path))
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, marked: bool = True) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there, and executors may be lost.

    Unless ``marked``, no marker of success is written. On a local folder without Hadoop's native library, that marker takes two of
    the five processes that the driver starts for a table, to set the modes of files and folders."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", marked).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def drop_written(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 1024) * 2, _MULTIPLIER, np.uint64), dtype=np.uint64)])
    return _powers[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True


def words_of(data: np.ndarray, at: np.ndarray, separates: np.ndarray = _SEPARATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all words of the texts at[i]:at[i+1], and the number of the first word of each text."""
    inside = ~separates[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    bounds = at[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    starts[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, at)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: All ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals made small."""
    out = _FOLD[data]
    second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][second] += 32
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, scrambled with its length."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    live = np.flatnonzero(sizes <= 64)
    with np.errstate(over="ignore"):
        for k in range(64):
            if not len(live):
                break
            out[live] = out[live] * _MULTIPLIER + (data[starts[live] + k].astype(np.uint64) + np.uint64(1))
            live = live[sizes[live] > k + 1]
        for i in np.flatnonzero(sizes > 64):
            word = data[starts[i] : ends[i]].astype(np.uint64) + np.uint64(1)
            out[i] = (word * powers(len(word))[::-1]).sum(dtype=np.uint64)
        return mix(out ^ (sizes.astype(np.uint64) << np.uint64(40)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, k):
            out = out * _MULTIPLIER + words[i : i + n]
    return mix(out)


def crc(data: bytes | memoryview) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class PieceCache:
    """Runs of ids of byte pieces, behind a direct-mapped table of 64-bit piece hashes that points into a bounded pool."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], slot_bits: int = 21, pool: int = 1 << 23):
        self.encode_new, self.slot_bits, self.least = encode, slot_bits, pool
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << self.slot_bits, np.uint64)
        self.places = np.zeros(1 << self.slot_bits, np.int32)
        self.sizes = np.zeros(1 << self.slot_bits, np.int32)
        self.pool = np.empty(self.least, np.int32)
        self.used = 0

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each piece has. ``encode_new`` gets each unknown piece once."""
        if self.used > self.least - (self.least >> 2):
            self._clear()
        hashes = word_hashes(data, starts, ends) | np.uint64(1)
        slots = (hashes >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        places, sizes = self.places[slots].astype(np.int64), self.sizes[slots].astype(np.int64)
        missing = np.flatnonzero(self.keys[slots] != hashes)
        if len(missing):
            _, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new = missing[one]
            raw = data.tobytes()
            ids, counts = self.encode_new([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new], ends[new], strict=True)])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(len(ids) + self.least, np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            places[missing], sizes[missing] = at[back], counts[back]
            to = slots[new]
            self.keys[to], self.places[to], self.sizes[to] = hashes[new], at, counts
        bounds = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(places - bounds, sizes) + np.arange(int(sizes.sum()))], sizes


#: Bits of the filter of ``likely_in``: 8 MB whatever the number of keys. A fuller filter lets more rows pass, never fewer.
FILTER_BITS = 26


def likely_in(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without most of those whose ``columns`` aren't in ``keys``, so that a join moves less: a filter of fixed size goes to all executors."""
    from pyspark.sql import functions as F

    return rows.where(likely_in_column(keys, *columns)(F.xxhash64(*columns)))


def likely_in_column(keys: DataFrame, *columns: str) -> Callable[[Column], Column]:
    """A test of xxhash64 values: true for those of all ``columns`` in ``keys``, and seldom for others."""
    from pyspark.sql import functions as F

    spot = F.shiftrightunsigned(F.xxhash64(*columns), 64 - FILTER_BITS)
    parts = keys.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("bits"))
    size = 4096
    bits = np.zeros((1 << FILTER_BITS) // 8 + size, np.uint8)
    for bucket, found in parts.toLocalIterator():
        # Buckets count from 1 and hold positions 32768 (bucket - 1) + 1 and on; position 0, without a bucket, always passes.
        if bucket > 0:
            bits[(bucket - 1) * size : bucket * size] = np.frombuffer(found, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.pandas_udf("boolean")
    def passes(spots: pd.Series) -> pd.Series:
        table = np.frombuffer(shared.value, np.uint8)
        at = spots.to_numpy() - 1
        return pd.Series(np.where(at < 0, True, (table[np.maximum(at, 0) >> 3] >> (np.maximum(at, 0) & 7)) & 1).astype(bool))

    return lambda hashes: passes(F.shiftrightunsigned(hashes, 64 - FILTER_BITS))
