"""Benchmark decontamination by SimHash windows of the items' sizes.

Texts are folded to lower case and split at everything but letters and digits. A document is compared with an item through
windows of as many words as the item has (fewer where the document ends). A window's SimHash, 64 bits over its shingles of five
words, each weighted by its length, is looked up in a multi-index: fingerprints are cut into blocks, and since any two within
the radius agree to radius // blocks bits in some block, looking up each block's near values finds all fingerprints within
it. What the index finds is verified by the exact weighted Jaccard similarity of the shingle sets.

Only windows that hold one of the item's shingles can have any similarity with it, so windows without one are left out
before hashing, which loses nothing. At the default radius, 23 of 64 bits, a pair at similarity 0.8, with an expected distance
under 10 bits and a standard deviation under 3, is past reach with a chance under one in a million. The price of so sure a radius
is that a block's near values are many: of unrelated items about a third pass the index (5 of 16 bits in one of 4 blocks), and
one in sixty the fingerprints' own distance, which leaves few to the exact comparison.

A text's windows are hashed in slices of at most ``SLICE`` windows, cut where they lie apart, and compared with as many items at
a time as keep the table of pairs bounded, so the memory for a text of any length is that of a slice.

The items go to all executors in blocks of at most ``block_bytes`` of text, one pass over the documents a block.

Defined results: a null or empty text has no hits; items without words are void; an item without an id hits with a null id; an item of fewer than five words is one
shingle of all its words; repeated items each hit, repeated documents are each judged; a document's hits on an item are one,
the best window, the first of equal ones; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lodeframe.llm.common import PUNCTUATION, folded, gram_hashes, text_buffers, word_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 4
SLICE = 4096
BLOCK_BYTES = 8 << 20
_GATE_BITS = 22
_PAIRS = 1 << 22
_BIT = np.arange(64, dtype=np.uint64)


def _hashed(data: np.ndarray, at: np.ndarray):
    """Hashes and sizes of all words, and the bounds of the texts among them."""
    data = folded(data)
    starts, ends, first = words_of(data, at, PUNCTUATION)
    return word_hashes(data, starts, ends), ends - starts, first


def _shingles(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of all runs of k words."""
    grams = gram_hashes(words, k)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return grams, (total[k:] - total[:-k])[: len(grams)] if len(grams) else np.zeros(0, np.int64)


def _fingerprints(grams: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHashes of the runs begin:end of shingles."""
    signs = (((grams[:, None] >> _BIT) & np.uint64(1)).astype(np.int64) * 2 - 1) * weights[:, None]
    sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs, axis=0)])
    bits = sums[end] - sums[begin] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _slices(n: int, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """range(n) in slices of at most ``SLICE``, none of which runs over a cut."""
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        for lo in range(a, b, SLICE):
            yield lo, min(b, lo + SLICE)


class Index:
    """The items of a block: their shingles, and a multi-index of their fingerprints for each size."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, blocks: int = BLOCKS):
        if 64 % blocks or 64 // blocks > 16:
            raise ValueError("blocks must cut 64 bits into parts of 16 at most")
        self.radius, self.bits = radius, 64 // blocks
        data, at = text_buffers(pa.array([x[1] for x in items], pa.string()))
        words, sizes, first = _hashed(data, at)
        self.by_size: dict[int, dict] = {}
        found: list[tuple[int, int]] = []
        for i, (item_id, _) in enumerate(items):
            own = slice(first[i], first[i + 1])
            n = first[i + 1] - first[i]
            if not n:
                continue
            k = min(SHINGLE, n)
            grams, weights = _shingles(words[own], sizes[own], k)
            group = self.by_size.setdefault(int(n), {"ids": [], "sets": [], "prints": [], "k": k})
            group["ids"].append(item_id)
            group["sets"].append(dict(zip(grams.tolist(), weights.tolist(), strict=True)))
            group["prints"].append(_fingerprints(grams, weights, np.zeros(1, int), np.array([len(grams)]))[0])
            found += [(g, int(n)) for g in grams.tolist()]
        # By how many bits two values of a block differ.
        self.apart = np.bitwise_count(np.arange(1 << self.bits, dtype=np.uint32))
        for group in self.by_size.values():
            group["prints"] = np.array(group["prints"], np.uint64)
            group["blocks"] = [self._block(group["prints"], b) for b in range(blocks)]
        # Gates by shingle length: sorted shingles, each with the sizes of the items that have it.
        self.gates = {}
        for k in sorted({g["k"] for g in self.by_size.values()}):
            own = sorted({(g, n) for g, n in found if min(SHINGLE, n) == k})
            keys = np.array([x[0] for x in own], np.uint64)
            gate = np.zeros(1 << _GATE_BITS, bool)
            gate[(keys >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
            self.gates[k] = (gate, keys, np.array([x[1] for x in own]))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _near(self, prints: np.ndarray, group: dict) -> Iterator[tuple[int, int]]:
        """The pairs of a print and an item that the index finds within the radius, by print and item."""
        reach = self.radius // len(group["blocks"])
        step = max(1, _PAIRS // len(group["prints"]))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            near = np.zeros((len(part), len(group["prints"])), bool)
            for b, values in enumerate(group["blocks"]):
                near |= self.apart[self._block(part, b)[:, None] ^ values[None, :]] <= reach
            w, j = np.nonzero(near)
            within = np.bitwise_count(part[w] ^ group["prints"][j]) <= self.radius
            yield from zip((w[within] + lo).tolist(), j[within].tolist(), strict=True)

    def hits(self, data: np.ndarray, at: np.ndarray, similarity: float) -> dict[int, list[tuple[int, int, int, float]]]:
        """By text: ``(item_id, first word, words, similarity)`` of each item's best window."""
        words, sizes, first = _hashed(data, at)
        out: dict[int, list] = {}
        for k, (gate, keys, key_sizes) in self.gates.items():
            grams, weights = _shingles(words, sizes, k)
            if not len(grams):
                continue
            maybe = np.flatnonzero(gate[(grams >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, grams[maybe], "left"), np.searchsorted(keys, grams[maybe], "right")
            maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
            text = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + k <= first[text + 1]
            maybe, lo, hi, text = maybe[inside], lo[inside], hi[inside], text[inside]
            if not len(text):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
                i = int(text[a])
                own = slice(first[i], first[i + 1] - k + 1)
                rows = self._hits(grams[own], weights[own], k, maybe[a:b] - first[i], [key_sizes[x:y] for x, y in zip(lo[a:b], hi[a:b], strict=True)], similarity)
                if rows:
                    out.setdefault(i, []).extend(rows)
        return out

    def _hits(self, grams, weights, k, places, place_sizes, similarity):
        rows = []
        last = len(grams)
        for n in sorted({int(x) for xs in place_sizes for x in xs}):
            group = self.by_size[n]
            span = n - k + 1
            wanted = np.zeros(max(1, last - span + 1), bool)
            for p, xs in zip(places.tolist(), place_sizes, strict=True):
                if n in xs:
                    wanted[max(0, p - span + 1) : min(p, len(wanted) - 1) + 1] = True
            begin = np.flatnonzero(wanted)
            end = np.minimum(begin + span, last)
            best: dict[int, tuple[float, int]] = {}
            apart = np.flatnonzero(begin[1:] > begin[:-1] + span) + 1
            for lo, hi in _slices(len(begin), apart):
                low, high = int(begin[lo]), int(end[hi - 1])
                prints = _fingerprints(grams[low:high], weights[low:high], begin[lo:hi] - low, end[lo:hi] - low)
                for w, j in self._near(prints, group):
                    w += lo
                    own = dict(zip(grams[begin[w] : end[w]].tolist(), weights[begin[w] : end[w]].tolist(), strict=True))
                    item = group["sets"][j]
                    common = sum(v for g, v in own.items() if g in item)
                    score = common / (sum(own.values()) + sum(item.values()) - common)
                    if score >= similarity and score > best.get(j, (0.0, 0))[0]:
                        best[j] = (score, w)
            rows += [(group["ids"][j], int(begin[w]), int(end[w] - begin[w]) + k - 1, score) for j, (score, w) in sorted(best.items())]
        return rows


_HIT = StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("n_words", LongType()), StructField("similarity", DoubleType())])
_ARROW_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with ``hits``, an array of ``(item_id, start, n_words, similarity)``, after their own columns."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = docs.drop("hits")
    schema = StructType([*out.schema.fields, StructField("hits", ArrayType(_HIT))])
    out = out.withColumn("hits", F.array().cast(schema["hits"].dataType))
    for b in range(blocks):
        # A block of the items, of bounded size, on the driver and to every executor.
        part = [tuple(x) for x in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        if part:
            out = out.mapInArrow(_flagger(spark.sparkContext.broadcast(part), similarity, radius, text), schema)
    return out


_indexes: dict[tuple, tuple[object, Index]] = {}


def _flagger(shared, similarity: float, radius: int, text: str):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (id(shared), radius)
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = (shared, Index(shared.value, radius))
        index = _indexes[key][1]
        for batch in source:
            at_text, at_hits = batch.schema.names.index(text), batch.schema.names.index("hits")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = index.hits(*text_buffers(part.column(at_text)), similarity)
                before = part.column(at_hits).to_pylist()
                hits = [(before[i] or []) + [dict(zip(("item_id", "start", "n_words", "similarity"), x, strict=True)) for x in found.get(i, ())] for i in range(part.num_rows)]
                columns = list(part.columns)
                columns[at_hits] = pa.array(hits, _ARROW_HIT)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return batches


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without hits."""
    return contamination(docs, benchmark, **options).where(F.size("hits") == 0).drop("hits")


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits: one row for each document and item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


#: The same without the index: every window that holds one of an item's shingles, compared exactly.
ORACLE = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS words FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, words, len(words) AS size, least(5, len(words)) AS k, len(words) - least(5, len(words)) + 1 AS span FROM b WHERE len(words) > 0),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS words FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
ds AS (
  SELECT doc_id, k, size, j, string_agg(word, ' ') OVER f AS shingle, sum(strlen(word)) OVER f AS weight
  FROM dw, (SELECT DISTINCT k FROM items) WHERE size >= k WINDOW f AS (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING)
  QUALIFY j <= size - k + 1
),
iw AS (SELECT item_id, k, size, span, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM items),
iw5 AS (
  SELECT item_id, k, size, span, j, string_agg(word, ' ') OVER f AS shingle, sum(strlen(word)) OVER f AS weight
  FROM iw WINDOW f AS (PARTITION BY item_id ORDER BY j ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) QUALIFY j <= span
),
ish AS (SELECT DISTINCT item_id, k, size, span, shingle, weight FROM iw5),
whole AS (SELECT item_id, sum(weight) AS total FROM ish GROUP BY item_id),
near AS (
  SELECT DISTINCT ds.doc_id, ish.item_id, ds.k, ish.span, ds.size,
    unnest(range(greatest(1, ds.j - ish.span + 1), least(ds.j, greatest(1, ds.size - ish.size + 1)) + 1)) AS s
  FROM ds JOIN ish ON ds.k = ish.k AND ds.shingle = ish.shingle
),
own AS (
  SELECT DISTINCT n.doc_id, n.item_id, n.s, n.k, least(n.span, n.size - n.k + 2 - n.s) AS held, ds.shingle, ds.weight
  FROM near n JOIN ds ON ds.doc_id = n.doc_id AND ds.k = n.k AND ds.j BETWEEN n.s AND n.s + n.span - 1
),
sums AS (
  SELECT own.doc_id, own.item_id, s, own.k, held, sum(own.weight) AS total, coalesce(sum(own.weight) FILTER (ish.shingle IS NOT NULL), 0) AS common
  FROM own LEFT JOIN ish ON own.item_id = ish.item_id AND own.shingle = ish.shingle GROUP BY ALL
),
scored AS (
  SELECT doc_id, sums.item_id, s, held + k - 1 AS words, common::DOUBLE / (sums.total + whole.total - common)::DOUBLE AS similarity
  FROM sums JOIN whole ON sums.item_id = whole.item_id
)
SELECT doc_id, item_id, (s - 1)::BIGINT AS start, words::BIGINT AS n_words, similarity FROM scored WHERE similarity >= 0.8::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""
