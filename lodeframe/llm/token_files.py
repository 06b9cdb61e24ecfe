"""Token ids as ORC files.

Each document is one row ``(doc_id, n_tokens, tokens)``. Spark's ORC writer run-length encodes the integers, keeps a
row index in every stripe and, as asked for here, a Bloom filter of ``doc_id``. Stripes are the unit of parallel reads, and
file, stripe and row-group statistics and the filters prune what a look-up by ``doc_id`` reads.

Defined results: a null text is an empty one and gives the end id alone; a null ``doc_id`` sorts first; rows that repeat a
``doc_id`` are all kept, in the order of their texts' hashes; an empty table gives a folder without rows; other columns of
the input, whatever their names, are left out.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import crc, shared_path, text_buffers, word_hashes, written

SCHEMA = "doc_id long, n_tokens long, tokens array<int>"

_SLOT_BITS = 21
_POOL = 1 << 23


def _flags(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_WHITE = _flags(b"\t\n\x0b\x0c\r ")
_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)))
_MARK = _flags(b".,!?;:")
#: First bytes of characters outside ASCII that may be white space: U+0085, U+00A0, U+1680, U+2000 and on, U+3000.
_WIDE = _flags(b"\xc2\xe1\xe2\xe3")


class Encoder:
    """The tokenizer behind a cache of pieces.

    Where no two white-space characters meet, a byte-level pre-tokenizer never joins what stands on two sides of the start of a
    space, of either side of a line end, or of the start of a stop after a letter. Texts are cut there, each different piece is
    encoded by the library, and a text's ids are those of its pieces in a row. Texts with other white space or with the string of
    an added token, and all texts of other kinds of tokenizers, are encoded whole. Pieces are known by 64-bit hashes in a direct-mapped table that points into a
    pool of ids; a piece that isn't there is encoded again, so neither can grow."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        parts = json.loads(tokenizer.to_str())
        kind = parts["pre_tokenizer"] or {}
        self.by_piece = bool(kind.get("type") == "ByteLevel" and kind.get("use_regex", True)) and not kind.get("add_prefix_space") and parts["normalizer"] is None
        line_end = tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece &= len(line_end) == 1
        self.line_end = line_end[0] if line_end else -1
        self.added = [x["content"].encode() for x in parts.get("added_tokens") or () if x["content"]]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.places = np.zeros(1 << _SLOT_BITS, np.int32)
        self.sizes = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool = np.empty(_POOL, np.int32)
        self.used = 0

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(x.ids, np.int32) for x in found]

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has. The library gets them as lines: a line end between pieces is a token of its own."""
        sizes = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        lines = data[np.minimum(np.repeat(starts - at[:-1], sizes) + np.arange(at[-1]), len(data) - 1)]
        lines[at[1:] - 1] = 10
        cuts = [*at[:-1:5000], at[-1]]
        ids = np.concatenate(self._whole([lines[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        line_ends = np.flatnonzero(ids == self.line_end)
        return np.delete(ids, line_ends), np.diff(line_ends, prepend=-1) - 1

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of new runs of ids in the pool."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(ids) + _POOL, np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids) + np.cumsum(sizes) - sizes

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts at[i]:at[i+1] of the bytes, each text's followed by the end id, and the n + 1 bounds of the texts among them."""
        n = len(at) - 1
        if self.used > _POOL - (_POOL >> 2):
            self._clear()
        white = _WHITE[data]
        odd = np.zeros(n, bool)
        if not self.by_piece:
            odd[:] = True
        elif len(data):
            hard = _WIDE[data]
            hard[1:] |= white[1:] & white[:-1]
            odd[np.searchsorted(at, np.flatnonzero(hard), "right") - 1] = True
            raw = data.tobytes()
            for token in self.added:
                place = raw.find(token)
                while place >= 0:
                    i = int(np.searchsorted(at, place, "right")) - 1
                    odd[i] = True
                    place = raw.find(token, int(at[i + 1]))
        cut = data == 32
        line = data == 10
        cut |= line
        cut[1:] |= line[:-1]
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        cut[at[:-1][at[:-1] < len(data)]] = True
        for i in np.flatnonzero(odd):
            cut[at[i] + 1 : at[i + 1]] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, at)
        if odd.any():
            own = first[:-1][odd & (at[1:] > at[:-1])]
            plain = np.ones(len(starts), bool)
            plain[own] = False
        else:
            own, plain = np.zeros(0, np.int64), np.ones(len(starts), bool)
        places, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(own):
            whole = self._whole([data[starts[i] : ends[i]].tobytes() for i in own])
            sizes[own] = list(map(len, whole))
            places[own] = self._put(np.concatenate(whole), sizes[own])
        lines = plain & (data[starts] == 10) if len(data) else plain
        if lines.any():
            places[lines], sizes[lines] = self._put(np.array([self.line_end], np.int32), np.ones(1, np.int64)), 1
        where = np.flatnonzero(plain & ~lines)
        hashes = word_hashes(data, starts[where], ends[where]) | np.uint64(1)
        slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        hit = self.keys[slots] == hashes
        places[where[hit]], sizes[where[hit]] = self.places[slots[hit]], self.sizes[slots[hit]]
        missing = where[~hit]
        if len(missing):
            _, one, back = np.unique(hashes[~hit], return_index=True, return_inverse=True)
            new = missing[one]
            new_ids, new_sizes = self._pieces(data, starts[new], ends[new])
            new_places = self._put(new_ids, new_sizes)
            places[missing], sizes[missing] = new_places[back], new_sizes[back]
            to = slots[~hit][one]
            self.keys[to], self.places[to], self.sizes[to] = hashes[~hit][one], new_places, new_sizes
            # Where two new pieces share a slot, numpy keeps the last of each assignment, which is the same one.
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        total = int(bounds[-1])
        flat = self.pool[np.repeat(places - bounds[:-1], sizes) + np.arange(total)]
        text_at = bounds[first]
        out = np.insert(flat, text_at[1:], end_id)
        return out, text_at + np.arange(n + 1)


_loaded: dict[tuple, tuple[object, Encoder]] = {}


def _encoder(shared, specials_as_text: bool) -> Encoder:
    """The encoder of a broadcast definition, made once in a worker."""
    key = (id(shared), specials_as_text)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = specials_as_text
        _loaded.clear()
        _loaded[key] = (shared, Encoder(tokenizer))
    return _loaded[key][1]


def encode(df: DataFrame, tokenizer_path: str, end_id: int = 2, specials_as_text: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, tokens)`` of ``(doc_id, text)``, in the order of the rows; the end id follows each document.

    The string of a special token in a text becomes that token's id, as the library has it unless told otherwise; with
    ``specials_as_text`` it is encoded as ordinary text, which is what texts from strangers want.

    The definition of the tokenizer, a few megabytes whatever the corpus, is read on the driver and broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, specials_as_text)
        for batch in source:
            for lo in range(0, batch.num_rows, 256):  # bounds what a batch of long texts holds
                part = batch.slice(lo, 256)
                flat, at = encoder.encode(*text_buffers(part.column("text")), end_id)
                sizes = np.diff(at)
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), tokens], ["doc_id", "n_tokens", "tokens"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, SCHEMA)


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, stripe_mb: int = 16, partitions: int | None = None) -> None:
    """Write the token ids of ``(doc_id, text)`` in ascending order of ``doc_id``, within files and from file to file.

    Texts are dealt out by ranges of ``doc_id`` and sorted before they are tokenized, so that the shuffle moves texts once and
    the ids never."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = texts.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    (
        encode(ordered, tokenizer_path, end_id)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on ``doc_id`` reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a few ids, read by metadata pruning."""
    return read(spark, path).where(F.col("doc_id").isin(*doc_ids))


def _digests(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        tokens = batch.column("tokens")
        values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<u4")
        at = tokens.offsets.to_numpy()
        sums = [crc(memoryview(values[a:b]).cast("B")) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), batch.column("file"), batch.column("block"), batch.column("seq")], ["doc_id", "n_tokens", "ids_crc32", "file", "block", "seq"])


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is a running sum within each file plus the sums of the files before it. Only one row a file meets in the small
    window over files."""
    rows = read(spark, path).select("doc_id", "tokens", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    rows = rows.mapInArrow(_digests, "doc_id long, n_tokens long, ids_crc32 long, file long, block long, seq long")
    rows = written(rows, "token-digests")
    # The number of a part file is that of its range.
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    files = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(files, "file")
        .select("doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return layout(spark, path)
