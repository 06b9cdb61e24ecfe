"""Removal of passages that an earlier document has, by FM-index shards.

A window is ``window`` consecutive words of one document; a word goes if some window that covers it also starts in a document
with a smaller ``doc_id``. Windows are judged on the input.

Of documents with equal words the first stands for all, and the later ones lose every word to it. Sharding is by content, so
that every occurrence of a window meets in one shard and none is compared elsewhere. The anchor of a window is the least of the
hashes of its runs of ``gram`` words (the leftmost, of equal ones); equal windows have equal anchors. Successive windows with one
anchor form a run, and only anchors of two or more documents matter, which an aggregation with map-side partial sums finds.
Runs of such anchors are slices; equal slices become one, with the least and the greatest ``doc_id`` that have it.

Slices are then trimmed to what can be shared: where a passage begins or ends, each document that quotes it has a slice with words
of its own, and their windows, being in one document alone, can be left out of the search. Hashes of windows say which; a
collision keeps a window too many. What is left of a slice, its pieces, goes to shards by anchor, equal ones once. A shard
builds a compressed FM-index of its pieces and streams them through it: backward search yields the matching statistics, and every
interval of windows that reaches the threshold is reported with the least ``doc_id`` that has it. An anchor with more words of
pieces than a shard is dealt out in parts by hash; each part is indexed, and each is streamed through the indexes of all.

Defined results: a null or empty text has no words; a null ``doc_id`` neither removes nor loses words; rows that repeat a
``doc_id`` don't remove words from each other, whatever their texts; a text shorter than the window stays whole; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import gram_hashes, likely_in, text_buffers, word_hashes, words_of, written
from lodeframe.llm.fm_index import FMIndex

WINDOW = 50
GRAM = 8
#: Words of pieces in a shard, as a rule.
SHARD_WORDS = 1_000_000
_POSITION = 28


def _runs(data: np.ndarray, at: np.ndarray, window: int, gram: int):
    """Words (starts, ends, bounds by text) and the runs of windows: text, first window, number of windows, anchor."""
    starts, ends, first = words_of(data, at)
    hashes = gram_hashes(word_hashes(data, starts, ends), gram)
    width = window - gram + 1
    if len(hashes) < width:
        none = np.zeros(0, np.int64)
        return starts, ends, first, none, none, none, np.zeros(0, np.uint64)
    mask = np.uint64((1 << _POSITION) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[: len(packed) - (width - step)], packed[width - step :])
    places = (packed & mask).astype(np.int64)
    # The text of each window, and -1 for one that runs over a text's end.
    text = np.searchsorted(first, np.arange(len(places)), "right") - 1
    inside = np.arange(len(places)) + window <= first[text + 1]
    text = np.where(inside, text, -1)
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(places)))
    keep = text[begin] >= 0
    begin, count = begin[keep], count[keep]
    return starts, ends, first, text[begin], begin, count, hashes[places[begin]]


def _parts(batch: pa.RecordBatch, rows: int = 256):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _profile(window: int, gram: int):
    """Per row: its words, the digest of all of them, and the anchors of its runs."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _parts(batch):
                data, at = text_buffers(part.column("text"))
                _, _, first, text, _, _, anchors = _runs(data, at, window, gram)
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                own = [np.unique(anchors[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(np.diff(first)), pa.array(digests, pa.binary()), lists], ["doc_id", "row_key", "n_words", "sha256", "anchors"])

    return batches


def _slices(window: int, gram: int):
    """Places and digests of the slices of a row's runs whose anchors are wanted."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _parts(batch):
                data, at = text_buffers(part.column("text"))
                starts, ends, _, text, begin, count, anchors = _runs(data, at, window, gram)
                first = np.searchsorted(starts, at)
                lists = part.column("anchors")
                wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                hit = np.zeros(len(text), bool)
                if len(wanted) and len(text):
                    known: dict[int, set] = {}
                    for row, a in zip(owner.tolist(), wanted.tolist(), strict=True):
                        known.setdefault(row, set()).add(a)
                    none: set = set()
                    hit = np.fromiter((a in known.get(t, none) for t, a in zip(text.tolist(), anchors.tolist(), strict=True)), bool, len(text))
                raw = data.tobytes()
                found = [b" ".join(raw[starts[b] : ends[b + c + window - 2]].split()) for b, c in zip(begin[hit], count[hit], strict=True)]
                rows = pa.array(text[hit])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("row_key").take(rows), pa.array(begin[hit] - first[text[hit]]), pa.array(count[hit]), pa.array(anchors[hit].view(np.int64)), pa.array([hashlib.md5(x).digest() for x in found], pa.binary())],
                    ["doc_id", "row_key", "first", "count", "anchor", "slice_key"],
                )

    return batches


def _given(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The slices that the rows are to give, with their rows' numbers."""
    lists = part.column("given")
    return np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _window_keys(window: int):
    """The hashes of the windows of the slices that a row is to give."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _parts(batch):
                owner, given = _given(part)
                data, at = text_buffers(part.column("text"))
                starts, ends, bounds = words_of(data, at)
                hashes = gram_hashes(word_hashes(data, starts, ends), window)
                first, count = given.field("first").to_numpy(), given.field("count").to_numpy()
                begin = bounds[owner] + first
                cuts = np.concatenate([[0], np.cumsum(count)])
                keys = hashes[np.repeat(begin - cuts[:-1], count) + np.arange(cuts[-1])]
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(keys.view(np.int64)))
                rows = pa.array(owner)
                columns = [part.column("doc_id").take(rows), part.column("row_key").take(rows), pa.array(first)]
                columns += [given.field("least"), given.field("greatest"), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "first", "least", "greatest", "keys"])

    return batches


def _pieces(window: int):
    """What is left of the slices that a row is to give: the intervals of their windows at ``places``, as texts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _parts(batch):
                owner, given = _given(part)
                places = [np.sort(np.array(x, np.int64)) for x in part.column("places").to_pylist()]
                words = [(x or "").encode().split() for x in part.column("text").to_pylist()]
                rows, offsets, texts = [], [], []
                first, count = given.field("first").to_pylist(), given.field("count").to_pylist()
                for t, (o, f, c) in enumerate(zip(owner.tolist(), first, count, strict=True)):
                    own = places[o][np.searchsorted(places[o], f) : np.searchsorted(places[o], f + c)]
                    for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1) if len(own) else ():
                        rows.append(t)
                        offsets.append(int(run[0]) - f)
                        texts.append(b" ".join(words[o][run[0] : run[-1] + window]))
                taken = given.take(pa.array(rows, pa.int64()))
                columns = [taken.field(x) for x in ("anchor", "slice_key", "least", "greatest")]
                columns += [pa.array(offsets, pa.int64()), pa.array([hashlib.md5(x).digest() for x in texts], pa.binary())]
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "slice_key", "least", "greatest", "at", "piece_key", "piece"])

    return batches


def _search(window: int):
    """One shard: index its pieces, stream pieces through the index, report the intervals of windows that an earlier document has."""

    def shard(table: pa.Table) -> pa.Table:
        pieces = pa.concat_arrays([x.cast(pa.string()) for x in table.column("piece").chunks])
        data, at = text_buffers(pieces)
        starts, ends, bounds = words_of(data, at)
        raw = data.tobytes()
        words = pa.array([raw[a:b] for a, b in zip(starts, ends, strict=True)], pa.binary()).dictionary_encode()
        symbols = words.indices.to_numpy().astype(np.int64) + 1

        def side(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = np.flatnonzero(table.column(name).to_numpy())
            sizes = np.diff(bounds)[rows]
            own = np.concatenate([[0], np.cumsum(sizes)])
            return rows, symbols[np.repeat(bounds[rows] - own[:-1], sizes) + np.arange(own[-1])], own

        indexed, text, text_bounds = side("indexed")
        streamed, stream, stream_bounds = side("streamed")
        least = table.column("least").to_numpy().astype(np.int64)[indexed]
        lengths, found = FMIndex(text, text_bounds, least, window).match(stream, stream_bounds)
        owner = np.repeat(np.arange(len(streamed)), np.diff(stream_bounds))
        report = (lengths == window) & (found < table.column("greatest").to_numpy()[streamed][owner])
        new = report.copy()
        new[1:] &= ~report[:-1] | (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        stop = report.copy()
        stop[:-1] &= ~report[1:] | (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        end = np.flatnonzero(stop) + 1
        keys = table.column("piece_key").take(pa.array(streamed[owner[begin]]))
        offsets = pa.array(begin - stream_bounds[owner[begin]])
        return pa.table({"piece_key": keys, "offset": offsets, "count": pa.array(end - begin), "earliest": pa.array(found[begin])})

    return shard


def earlier_windows(pieces: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(piece_key, offset, count, earliest)``: intervals of windows of different pieces ``(anchor, piece_key, piece, least, greatest)``
    which a document before ``greatest`` has."""
    sizes = pieces.groupBy("anchor").agg(F.sum(F.size(F.split("piece", " "))).alias("words"))
    sizes = written(sizes.withColumn("parts", F.floor(F.col("words") / shard_words) + 1), "piece-anchors")
    total = sizes.where("parts = 1").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("piece_key"), F.col("parts"))
    dealt = pieces.join(sizes.select("anchor", "parts"), "anchor").withColumn("part", part)
    # A small anchor's pieces go to one shard, with other anchors. Of the parts of a large one, any two meet, and one of the two is indexed.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    meetings = F.when(F.col("part") == F.col("other"), F.array(_meeting("part", "part", True, True)))
    meetings = meetings.otherwise(F.array(_meeting("part", "other", True, False), _meeting("other", "part", False, True)))
    dealt = dealt.withColumn("meeting", F.explode(meetings))
    small = F.pmod(F.xxhash64("anchor"), F.lit(total // shard_words + 1))
    shard = F.when(F.col("parts") == 1, F.xxhash64(small)).otherwise(F.xxhash64("anchor", "meeting.index", "meeting.stream"))
    columns = [shard.alias("shard"), "meeting.indexed", "meeting.streamed", "piece_key", "piece", "least", "greatest"]
    return dealt.select(*columns).groupBy("shard").applyInArrow(_search(window), "piece_key binary, offset long, count long, earliest long")


def _meeting(index: str, stream: str, indexed: bool, streamed: bool):
    sides = (F.lit(indexed).alias("indexed"), F.lit(streamed).alias("streamed"))
    return F.struct(F.col(index).alias("index"), F.col(stream).alias("stream"), *sides)


def _remove(window: int):
    """Row results from the intervals of words to remove."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in _parts(batch):
                removed, digests, texts = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.string())], ["doc_id", "row_key", "n_removed", "kept_sha256", "kept"])

    return batches


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, texts: bool = False) -> DataFrame:
    """Per row of ``(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256`` and, if ``texts``, the ``kept`` words joined by spaces."""
    if not 0 < gram <= window:
        raise ValueError("an anchor's words must fit in the window")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("text"))
    profile = written(rows.mapInArrow(_profile(window, gram), "doc_id long, row_key long, n_words long, sha256 binary, anchors array<long>"), "substring-profile")
    # Texts of equal words: the first document stands for all; every later one loses all of its words to it.
    long_enough = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
    classes = profile.where(long_enough).groupBy("sha256").agg(F.min(F.struct("doc_id", "row_key")).alias("head"))
    classes = written(classes.select("sha256", F.col("head.doc_id").alias("head_id"), F.col("head.row_key").alias("head_key")), "substring-classes")
    heads = profile.join(classes.select(F.col("head_id").alias("doc_id"), F.col("head_key").alias("row_key"), "sha256"), ["doc_id", "row_key", "sha256"])
    anchors = written(heads.select("doc_id", "row_key", F.explode("anchors").alias("anchor")), "substring-anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")).where("least < greatest").select("anchor")
    wanted = written(anchors.join(repeated, "anchor").groupBy("doc_id", "row_key").agg(F.collect_set("anchor").alias("anchors")), "substring-wanted")
    # Documents with such anchors, once each; the others are done.
    affected = likely_in(rows, wanted, "doc_id", "row_key").join(wanted, ["doc_id", "row_key"]).dropDuplicates(["doc_id", "row_key"])
    affected = written(affected, "substring-affected")
    slices = affected.mapInArrow(_slices(window, gram), "doc_id long, row_key long, first long, count long, anchor long, slice_key binary")
    slices = written(slices, "substring-slices")
    # Of equal slices the first document that has it gives one.
    holder = F.min(F.struct("doc_id", "row_key", "first", "count")).alias("holder")
    different = slices.groupBy("anchor", "slice_key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), holder)
    given = F.collect_list(F.struct("holder.first", "holder.count", "anchor", "slice_key", "least", "greatest")).alias("given")
    givers = different.groupBy("holder.doc_id", "holder.row_key").agg(given)
    givers = affected.select("doc_id", "row_key", "text").join(givers, ["doc_id", "row_key"])
    givers = written(givers, "substring-givers")
    schema = "doc_id long, row_key long, first long, least long, greatest long, keys array<long>"
    windows = written(givers.mapInArrow(_window_keys(window), schema), "substring-windows")
    bounds = windows.select(F.explode("keys").alias("key"), "least", "greatest").groupBy("key")
    shared = bounds.agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).where("least < greatest").select("key")
    places = windows.select("doc_id", "row_key", "first", F.posexplode("keys").alias("at", "key")).join(shared, "key", "left_semi")
    places = places.groupBy("doc_id", "row_key").agg(F.collect_list(F.col("first") + F.col("at")).alias("places"))
    schema = "anchor long, slice_key binary, least long, greatest long, at long, piece_key binary, piece string"
    trimmed = givers.join(places, ["doc_id", "row_key"]).mapInArrow(_pieces(window), schema)
    trimmed = written(trimmed, "substring-pieces")
    pieces = trimmed.groupBy("anchor", "piece_key")
    pieces = pieces.agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.first("piece").alias("piece"))
    found = earlier_windows(written(pieces, "substring-different"), window, shard_words)
    found = trimmed.select("slice_key", "at", "piece_key").join(found, "piece_key")
    found = found.select("slice_key", (F.col("at") + F.col("offset")).alias("offset"), "count", "earliest")
    places = slices.select("slice_key", "doc_id", "row_key", "first").join(found, "slice_key").where("earliest < doc_id")
    start = F.col("first") + F.col("offset")
    spans = places.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("count") + (window - 1)).alias("end"))).alias("spans"))
    results = affected.join(spans, ["doc_id", "row_key"]).mapInArrow(_remove(window), "doc_id long, row_key long, n_removed long, kept_sha256 string, kept string")
    if not texts:
        results = results.drop("kept")
    results = results.withColumnsRenamed({"doc_id": "head_id", "row_key": "head_key"})
    out = profile.drop("anchors").join(classes, "sha256", "left").join(results, ["head_id", "head_key"], "left")
    headed = F.col("head_id").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    copied = headed & (F.col("doc_id") > F.col("head_id"))
    removed = F.when(copied, F.col("n_words")).when(headed, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).alias("n_removed")
    own = F.lower(F.hex("sha256"))
    kept_sha = F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).when(headed, F.coalesce("kept_sha256", own)).otherwise(own).alias("kept_sha256")
    columns = ["doc_id", "n_words", removed, kept_sha]
    if texts:
        whole = rows.dropDuplicates(["doc_id", "row_key"])
        out = out.join(whole, out.doc_id.eqNullSafe(whole.doc_id) & (out.row_key == whole.row_key)).drop(whole.doc_id, whole.row_key)
        plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
        columns.append(F.when(copied, F.lit("")).when(headed, F.coalesce("kept", plain)).otherwise(plain).alias("kept"))
    return out.select(*columns)


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by whole windows: each word sequence with the least document that has it.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
v AS (
  SELECT doc_id, j, word, CASE WHEN count(*) OVER f = 50 THEN sha256(string_agg(word, ' ') OVER f) END AS content FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
m AS (SELECT content, min(doc_id) AS least FROM v WHERE content IS NOT NULL GROUP BY content),
r AS (
  SELECT v.doc_id, v.j, v.word, coalesce(v.j - max(CASE WHEN m.least < v.doc_id THEN v.j END) OVER (PARTITION BY v.doc_id ORDER BY v.j) < 50, false) AS gone
  FROM v LEFT JOIN m ON v.content = m.content
),
k AS (SELECT doc_id, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""
