"""Near-duplicate classes by Order MinHash and banded alignment.

Texts are folded to lower case and split at everything but letters and digits; their k-mers are runs of five words, labelled by
occurrence so that the third of three equal ones differs from the first. A sketch takes the few k-mers that are least under
one hash function and keeps them in the order of the text, so two texts agree in it where they share those k-mers in the
same order, as texts at a small edit distance do. Candidates agree in one of the sketches.

Candidates are verified by banded alignment of their words: the longest chain of equal k-mers in the order of both texts, within
the band that the threshold leaves, fixes what is equal; between neighbours of the chain, stretches of up to ``STRETCH`` words
are aligned word by word, and longer ones count as different. With ``e`` words inserted, deleted or replaced, the similarity is
1 - e / max(n1, n2); it is never above that of the best alignment of all, and equal to it unless edits crowd. Classes are the
connected components of verified links.

Texts with equal words are one node from the start. A bucket of a sketch compares its members with its leader, the least
document, so a group of copies makes a few links a member and is one class then. Buckets whose members
are of several classes even so, as those of a passage that many texts quote, go on: those with leaders of one class as one
group, if its pairs are fewer so, and any other by itself. A group's members meet in blocks of bounded size, each pair in the
group of the first bucket that it shares, and pairs of different classes are verified if so many of their words are common
that the threshold can be reached. So no link between candidates is lost, and pairs leave a block as links alone.

Defined results: a text without words, or null, is a class of its own, and so are others like it; one of fewer than five words is
one k-mer; rows that repeat a ``doc_id`` are each put in the class of their own text; a class's id is its least ``doc_id`` (nulls
come last, and a class of nulls alone has a null id); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import (
    PUNCTUATION,
    folded,
    gram_hashes,
    likely_in,
    likely_in_column,
    mix,
    text_buffers,
    word_hashes,
    words_of,
    written,
)
from lodeframe.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
KEPT = 3
#: Words between neighbours of a chain that are aligned word by word.
STRETCH = 64
#: Words in a part of the members of one group, as a rule.
BLOCK_WORDS = 100_000


def labelled(grams: np.ndarray) -> np.ndarray:
    """k-mer hashes, the second and later ones of equal ones changed by their count."""
    order = np.argsort(grams, kind="stable")
    same = np.zeros(len(grams), bool)
    same[1:] = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return grams
    at = np.arange(len(grams))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    out = grams.copy()
    with np.errstate(over="ignore"):
        out[order] = np.where(same, mix(grams[order] + (at - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), grams[order])
    return out


def kmers(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    return labelled(gram_hashes(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(grams: np.ndarray, n: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One hash for each sketch: of the ``kept`` least k-mers under its hash function, in text order."""
    out = np.zeros(n, np.uint64)
    kept = min(kept, len(grams))
    with np.errstate(over="ignore"):
        for t, seed in enumerate(_seeds(n)):
            values = grams * seed
            values ^= values >> np.uint64(29)
            values *= seed
            places = np.sort(np.argpartition(values, kept - 1)[:kept]) if kept < len(grams) else np.arange(kept)
            h = seed
            for g in grams[places]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + g
            out[t] = h
    return mix(out)


def _distance(a: list[int], b: list[int]) -> int:
    """The edit distance of two sequences, by bit vectors over the first."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for x in b:
        equal = places.get(x, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right, left = down | (~(diagonal | up) & every), up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | (~(equal | down | right) & every), right & (equal | down)
    return score


def _chain(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain that rises in both of the pairs ``(i, j)``, which are sorted by ``i``."""
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return i, j
    tails: list[int] = []
    at_tail: list[int] = []
    before: list[int] = []
    for t, x in enumerate(j.tolist()):
        at = bisect_left(tails, x)
        tails[at : at + 1], at_tail[at : at + 1] = [x], [t]
        before.append(at_tail[at - 1] if at else -1)
    t, kept = at_tail[-1], []
    while t >= 0:
        kept.append(t)
        t = before[t]
    return i[kept[::-1]], j[kept[::-1]]


class Parsed:
    """A text's word hashes and its labelled k-mers, sorted, with their places."""

    def __init__(self, words: np.ndarray, k: int):
        self.words, self.k = words, min(k, len(words))
        grams = kmers(words, k)
        self.places = np.argsort(grams)
        self.grams = grams[self.places]

    def __len__(self) -> int:
        return len(self.words)


def aligned(a: Parsed, b: Parsed, similarity: float = SIMILARITY) -> float:
    """The similarity of two texts by alignment; 0 where it is below the threshold."""
    n, m = len(a), len(b)
    longer = max(n, m)
    spare = int((1 - similarity) * longer + 1e-9)
    if not n or not m or longer - min(n, m) > spare or a.k != b.k:
        return 0.0
    at = np.minimum(np.searchsorted(b.grams, a.grams), len(b.grams) - 1)
    equal = b.grams[at] == a.grams
    i, j = a.places[equal], b.places[at[equal]]
    near = np.abs(i - j) <= spare
    order = np.argsort(i[near])
    i, j = _chain(i[near][order], j[near][order])
    if not len(i):
        return 0.0
    # The stretches before, between and behind the chain's k-mers; where two overlap, none, or what one text has more.
    from_a, from_b = np.concatenate([[0], i + a.k]), np.concatenate([[0], j + b.k])
    in_a, in_b = np.append(i, n) - from_a, np.append(j, m) - from_b
    overlap = np.minimum(np.minimum(in_a, in_b), 0)
    in_a, in_b = in_a - overlap, in_b - overlap
    high, low = np.maximum(in_a, in_b), np.minimum(in_a, in_b)
    open_ones = (low > 0) & (high > 1) & (high <= STRETCH)
    # A stretch that is left out of the chain has an edit at least, and one for each word that one text has more.
    edits = int(high[~open_ones].sum())
    least = edits + int(np.maximum(high - low, 1)[open_ones].sum())
    if least > spare:
        return 0.0
    for t in np.flatnonzero(open_ones).tolist():
        x, y = int(from_a[t]), int(from_b[t])
        edits += _distance(a.words[x : x + int(in_a[t])].tolist(), b.words[y : y + int(in_b[t])].tolist())
        if edits > spare:
            return 0.0
    return 1 - edits / longer


def _hashed(column: pa.Array):
    data, at = text_buffers(column)
    data = folded(data)
    starts, ends, first = words_of(data, at, PUNCTUATION)
    return data, starts, ends, word_hashes(data, starts, ends), first


def _profile(k: int, n: int, kept: int):
    """Per row: the node of its words, their number and its sketches; nulls for a text without words."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                _, _, _, hashes, first = _hashed(part.column("text"))
                nodes, sizes, found = [], [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    if a == b:
                        nodes.append(None)
                        sizes.append(0)
                        found.append(np.zeros(0, np.uint64))
                        continue
                    grams = kmers(hashes[a:b], k)
                    nodes.append(int.from_bytes(hashlib.md5(hashes[a:b].tobytes()).digest()[:8], "little", signed=True))
                    sizes.append(int(b - a))
                    found.append(sketches(grams, n, kept))
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "row_key", "node", "size", "sketches"])

    return batches


def _parsed(column: pa.Array, k: int) -> list[Parsed]:
    _, _, _, hashes, first = _hashed(column)
    return [Parsed(hashes[x:y], k) for x, y in zip(first[:-1], first[1:], strict=True)]


def _verify(k: int, similarity: float):
    """The pairs ``(a, b, text_a, text_b)`` that pass."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                own = part.column("a").to_numpy()
                # Rows of one leader come together: its text is parsed once.
                new = np.concatenate([[True], own[1:] != own[:-1]])
                left = _parsed(part.column("text_a").take(pa.array(np.flatnonzero(new))), k)
                right = _parsed(part.column("text_b"), k)
                which = np.cumsum(new) - 1
                good = [aligned(left[w], r, similarity) > 0 for w, r in zip(which, right, strict=True)]
                rows = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([part.column("a").take(rows), part.column("b").take(rows)], ["a", "b"])

    return batches


def _verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, name: str) -> DataFrame:
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_verify(k, similarity), "a long, b long"), name)


def _block(k: int, similarity: float):
    """One block of members of a group: the links ``(a, b)`` of classes that its pairs add."""

    def links(table: pa.Table) -> pa.Table:
        texts = pa.concat_arrays(table.column("text").chunks)
        labels = table.column("label").to_pylist()
        parts = table.column("part").to_numpy()
        all_sketches = np.array(table.column("sketches").to_pylist(), np.int64)
        # The sketches by which each row is in the group.
        here = np.zeros(all_sketches.shape, bool)
        for r, ts in enumerate(table.column("ts").to_pylist()):
            here[r, ts] = True
        rows = _parsed(texts, k)
        sizes = np.array([len(x) for x in rows])
        # Postings of words, the second of equal ones of a text being another word.
        words = [labelled(x.words) for x in rows]
        flat, owner = np.concatenate(words), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        # Two parts meet across alone; a part that has come by itself meets within.
        across = table.column("across")[0].as_py()
        parent = {x: x for x in labels}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for r in range(len(rows) - 1):
            lo, hi = np.searchsorted(flat, words[r], "left"), np.searchsorted(flat, words[r], "right")
            runs = hi - lo
            at = np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
            common = np.bincount(owner[at], minlength=len(rows))
            longer = np.maximum(sizes, sizes[r])
            able = common >= similarity * longer - 1e-9
            able[: r + 1] = False
            if across:
                able &= parts != parts[r]
            others = np.flatnonzero(able)
            # The group of the first bucket that both are in judges them.
            equal = all_sketches[others] == all_sketches[r]
            others = others[equal.any(axis=1) & here[r, equal.argmax(axis=1)]]
            for o in others.tolist():
                x, y = root(labels[r]), root(labels[o])
                if x != y and aligned(rows[r], rows[o], similarity):
                    parent[max(x, y)] = min(x, y)
                    found.append((labels[r], labels[o]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return links


def _members(named: DataFrame) -> DataFrame:
    """``(group, node, size, label, ts)``: the members of the buckets that hold several classes, once in each group.

    Buckets with leaders of one class, as near copies fill many of, are one group where that makes fewer pairs than one by one;
    ``ts`` are the sketches by which a member is in the group."""
    of_leader = F.max(F.when(F.col("node") == F.col("leader"), F.col("label"))).alias("family")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), of_leader, F.count("*").alias("n"), F.sum("size").alias("words"))
    mixed = written(mixed.where("low <> high").select("bucket", "family", "n", "words"), "omh-mixed")
    rows = named.join(mixed.select("bucket", "family"), "bucket")
    union = rows.groupBy("family", "node").agg(F.first("size").alias("size")).groupBy("family").agg((F.count("*") * F.sum("size")).alias("together"))
    apart = mixed.groupBy("family").agg(F.sum(F.col("n") * F.col("words")).alias("apart"))
    joint = written(union.join(apart, "family").where("together <= apart").select("family", F.xxhash64("family").alias("joint")), "omh-joint")
    rows = rows.join(joint, "family", "left").withColumn("group", F.coalesce("joint", "bucket"))
    return written(rows.groupBy("group", "node").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.collect_list("t").alias("ts")), "omh-members")


def _class_links(met: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, similarity: float, block_words: int) -> DataFrame:
    """Links ``(a, b)`` between classes, by the pairs of members of buckets that hold several classes.

    A member meets its text once in a group. A group of many words is dealt out by hash in parts, and any two parts meet in a
    block, so a member is moved once a part."""
    named = met.where("n > 2").select("bucket", "leader", "t", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = _members(written(named, "omh-named"))
    sizes = members.groupBy("group").agg((F.floor(F.sum("size") / block_words) + 1).alias("parts"))
    full = members.join(nodes.select("node", "sketches"), "node").join(texts, "node").join(sizes, "group")
    full = full.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    full = full.withColumn("other", other).withColumn("across", F.col("part") != F.col("other"))
    block = F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")).alias("block")
    full = full.select("node", "ts", "label", "part", "across", block, "sketches", "text")
    return full.groupBy("block").applyInArrow(_block(k, similarity), "a long, b long").distinct()


def classify(
    docs: DataFrame,
    k: int = SHINGLE,
    similarity: float = SIMILARITY,
    n_sketches: int = SKETCHES,
    kept: int = KEPT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of ``(doc_id, text)``: ``doc_id, row_key, node, class, class_id``, where ``row_key`` is the hash of the text that tells
    rows of one ``doc_id`` apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("text"))
    schema = "doc_id long, row_key long, node long, size long, sketches array<long>"
    profile = written(rows.mapInArrow(_profile(k, n_sketches, kept), schema), "omh-profile")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("rep")
    nodes = profile.where("node IS NOT NULL").groupBy("node")
    nodes = written(nodes.agg(first, F.first("size").alias("size"), F.first("sketches").alias("sketches")), "omh-nodes")
    members = nodes.select("node", "size", F.col("rep.doc_id").alias("rep"), F.posexplode("sketches").alias("t", "sketch"))
    members = members.select("node", "size", "rep", "t", F.xxhash64("t", "sketch").alias("bucket"))
    leader = F.min(F.struct(F.col("rep").isNull(), "rep", "node", "size")).alias("leader")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), leader).where("n > 1")
    buckets = buckets.select("bucket", "n", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size"))
    met = written(members.drop("rep").join(buckets, "bucket"), "omh-buckets")
    # The texts of all nodes that share a bucket, once each.
    wanted = written(met.select("node").distinct().join(nodes.select("node", "rep.doc_id", "rep.row_key"), "node"), "omh-wanted")
    same = rows.doc_id.eqNullSafe(wanted.doc_id) & (rows.row_key == wanted.row_key)
    texts = likely_in(rows, wanted, "doc_id", "row_key").join(wanted, same).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "omh-texts")
    close = f"node <> leader AND size >= {similarity} * leader_size - 1e-6 AND leader_size >= {similarity} * size - 1e-6"
    pairs = met.where(close).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(_verified(pairs, texts, k, similarity, "omh-links"))
    more = written(_class_links(met, labels, nodes, texts, k, similarity, block_words), "omh-class-links")
    named = nodes.select("node", F.col("rep.doc_id").alias("rep")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if more.limit(1).count():
        higher = components(more).select(F.col("node").alias("label"), F.col("label").alias("higher"))
        named = named.join(higher, "label", "left").select("node", "rep", F.coalesce("higher", "label").alias("label"))
    named = written(named, "omh-classes")
    ids = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = named.join(ids, "label").select("node", "label", "class_id")
    out = profile.select("doc_id", "row_key", "node").join(classes, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return out.select("doc_id", "row_key", "node", F.col("label").alias("class"), class_id)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of ``docs``: that of the least ``doc_id``. Rows without words all stay."""
    classes = classify(docs, **options)
    first = F.row_number().over(Window.partitionBy("class").orderBy(F.col("doc_id").asc_nulls_last(), "row_key"))
    # The choice is made among ids; copies of the chosen row itself are told apart where the rows are.
    heads = classes.where("node IS NOT NULL").select("class", "doc_id", "row_key").distinct().withColumn("_first", first)
    gone = written(heads.where("_first > 1").select("doc_id", "row_key"), "omh-gone")
    rows = docs.withColumn("_key", F.xxhash64(F.col("text").cast("string"))).withColumn("_id", F.col("doc_id").cast("long"))
    # Only rows that the filter can't clear are moved for the join.
    likely = likely_in_column(gone, "doc_id", "row_key")(F.xxhash64("_id", "_key"))
    marked = rows.withColumn("_likely", likely)
    suspects = marked.where("_likely").join(gone, F.col("_id").eqNullSafe(gone.doc_id) & (F.col("_key") == gone.row_key), "left_anti")
    kept = marked.where("NOT _likely").unionByName(suspects)
    if _repeats(classes):
        worded = F.coalesce(F.col("text").cast("string").rlike(r"[0-9A-Za-z\u0080-\x{10FFFF}]"), F.lit(False))
        kept = kept.where(~worded).unionByName(kept.where(worded).dropDuplicates(["_id", "_key"]))
    return kept.drop("_key", "_id", "_likely")


def _repeats(classes: DataFrame) -> bool:
    """Whether some row with words comes twice."""
    return bool(classes.where("node IS NOT NULL").groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count())


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "class_id")
