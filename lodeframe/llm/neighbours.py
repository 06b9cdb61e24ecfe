"""Approximate nearest neighbours: neighbour graphs by NN-descent, searched greedily.

Equal vectors are one node, with the least few of their ids as its members. Nodes are dealt out by hash to shards, each of which has
a graph of its own and is one task's work, so that vectors move once and not once a link and round. Every node is in one shard, and
every query searches all shards; the nearest of all shards are its result.

A graph starts from blocks: under each of some random projections, nodes with equal signs are compared with each other. NN-descent
then improves it round by round, on the principle that a neighbour of a neighbour is probably a neighbour: links are taken both
ways, the vectors at the ends of each node's links meet at that node, and each of them keeps those of the others that are nearer
than its farthest neighbour. The rounds go on until few links change.
Vectors travel as single-precision numbers there, relative to a centre; what is returned is measured on the originals in double
precision.

A search keeps a beam of the nearest nodes found so far. Each round expands the nearest few that aren't expanded yet: their
neighbours, both ways, are measured and join in, until nothing is left to expand. It starts from the nodes of the query's blocks
under the first few projections, or of one part of a block that is cut, and from a few nodes of the shard.

How wide a beam must be depends on the table. So some nodes are probes: their true neighbours come from one pass over all nodes, in
which they are searched for too, with beams half as wide again until most are found or nothing more can be reached. The first beam that finds
enough of the nearest in all shards is taken; a shortfall gives a warning.

Sizes: a shard has at most ``CELLS`` components of vectors, whatever the table's size, and tables of over ``LEAST`` nodes have several.
A block of more than four times ``block`` nodes is cut at random into parts; a node with more than ``hub`` incoming links has its meeting
dealt out in parts as well, each with all of the node's own links. Nothing is left out of a graph's candidates otherwise. A query is
asked once in each shard, so a search grows with the square of a table, as far as queries are a share of it.

Defined results: null vectors, zero vectors and those with null or non-finite components take no part; vectors of equal length
alone are compared, so a table of several lengths is searched by length; rows that repeat an id and vector are one; ties go to the smaller
id; a query with fewer candidates than asked for gets all; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import likely_in, written

NEIGHBOURS = 24
TREES = 8
BLOCK = 64
CHANGED = 0.01
BEAM = 16
PROBES = 200
RECALL = 0.93
EXPAND = 32
HUB = 400
CELLS = 1 << 22
SHARDS = 4
LEAST = 4096
#: Projections whose blocks a search starts from, and other nodes that it starts from.
STARTS = 4
SPREAD = 16
#: Queries that a task searches for at once.
AT_ONCE = 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, embedding)`` with double components, of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def _floats(column: pa.Array) -> np.ndarray:
    """Vectors kept as the bytes of single-precision numbers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _doubles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors kept as the bytes of double-precision numbers: the rows of each length, and their matrix."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // 8
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield own, np.frombuffer(b"".join(column.take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), int(size))


def _bytes(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x)]


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vector`` as the bytes of double-precision numbers; zeros have no sign, so that equal vectors have equal bytes."""
    for batch in source:
        vectors, out = batch.column("vector"), [b""] * len(batch)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            for i, row in zip(own, _bytes(_matrix(vectors.take(pa.array(own))) + 0.0), strict=True):
                out[i] = row
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [batch.schema.names[0], "vector"])


def _same(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different vector of a batch, by id, and how many of the rows from there on are its ``k`` + 1 least ids."""
    rank: dict[bytes, int] = {}
    same = np.array([rank.setdefault(v, len(rank)) for v in batch.column("vector").to_pylist()], np.int64)
    ids = batch.column("vec_id").to_numpy()
    order = np.lexsort((ids, same))
    different = np.ones(len(order), bool)
    different[1:] = (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[different]
    _, counts = _runs(same[order])
    kept = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) <= k
    return order[kept], np.minimum(counts, k + 1)


def _thinned(k: int):
    """``vector`` as bytes, and the ``k`` + 1 least ids of each in each batch."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _packed(source):
            yield batch.take(pa.array(_same(batch, k)[0]))

    return batches


def _merged(k: int):
    """The vectors of batches sorted by ``hash``, each once with its ``k`` + 1 least ids; a hash may run on from batch to batch."""

    def once(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        order, counts = _same(rows, k)
        ids, first = rows.column("vec_id").take(pa.array(order)), np.cumsum(counts) - counts
        members = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), ids)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), rows.column("vector").take(pa.array(order[first])), members], ["node", "vector", "members"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in source:
            if not len(batch):
                continue
            hashes = batch.column("hash").to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))
            if held and (cut or held[-1].column("hash")[-1].as_py() != hashes[0]):
                yield once([*held, batch.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield once([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield once(held)

    return batches


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """``(node, vector, members)``: each different vector once, as the bytes of its numbers, under its least id, with its ``k`` + 1 least
    ids. These are taken in each batch before the shuffle too, so that copies of one vector don't meet in one task."""
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", F.col("embedding").alias("vector")).mapInArrow(_thinned(k), "vec_id long, vector binary")
    rows = rows.withColumn("hash", F.xxhash64("vector")).repartition(shuffles, "hash").sortWithinPartitions("hash")
    return rows.mapInArrow(_merged(k), "node long, vector binary, members array<long>")


def _size() -> Column:
    return F.floor(F.octet_length("vector") / 8).cast("int").alias("size")


def _sizes(nodes: DataFrame) -> DataFrame:
    """``(size, shards)``: among how many shards the nodes of each length are dealt."""
    counts = nodes.groupBy(_size()).agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1024), F.floor(F.lit(CELLS) / F.col("size")))
    few = F.least(F.lit(SHARDS), F.ceil(F.col("n") / LEAST))
    return counts.select("size", F.greatest(F.ceil(F.col("n") / most), few).alias("shards"))


def _points(nodes: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map of batches: ``vector`` becomes ``point``, its components relative to the largest of all and to a mean of some nodes.

    Neither is exact; they keep numbers in single precision's range, and small distances of vectors far from zero in its precision."""

    def largest_of(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            most = max((np.abs(x).max() for _, x in _doubles(batch.column("vector"))), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([float(most)])], ["most"])

    largest = nodes.select("vector").mapInArrow(largest_of, "most double").agg(F.max("most")).first()[0] or 1.0
    some: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node"), "node").limit(PROBES).select("vector").collect():
        some.setdefault(len(r.vector) // 8, []).append(np.frombuffer(r.vector) / largest)
    centres = {size: np.mean(vectors, axis=0) for size, vectors in some.items()}

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            points: list = [None] * len(batch)
            for own, x in _doubles(batch.column("vector")):
                for i, row in zip(own, _bytes((x / largest - centres.get(x.shape[1], 0.0)).astype(np.float32)), strict=True):
                    points[i] = row
            others = [c for c in batch.schema.names if c != "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(points, pa.binary())], [*others, "point"])

    return batches


def _pieces(source: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each key with its rows in each batch, of batches sorted by it."""
    for batch in source:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield int(keys[a]), batch.slice(a, b - a)


def _groups(source: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Each key with all its rows; a group may run on from batch to batch."""
    now, held = None, []
    for at, piece in _pieces(source, key):
        if held and at != now:
            yield now, pa.Table.from_batches(held)
            held = []
        now = at
        held.append(piece)
    if held:
        yield now, pa.Table.from_batches(held)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def _axes(seed: int, tree: int, size: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, size]).normal(size=(size, bits)).astype(np.float32)


def _codes(x: np.ndarray, seed: int, tree: int, bits: int) -> np.ndarray:
    """The block of each vector under a projection."""
    return (x @ _axes(seed, tree, x.shape[1], bits) > 0) @ (1 << np.arange(bits, dtype=np.int64))


def _blocks(x: np.ndarray, seed: int, tree: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in the order of their blocks under a projection, the code of each in it, and starts and sizes of blocks' parts."""
    codes = _codes(x, seed, tree, _bits(len(x), block))
    mixed = np.random.default_rng([seed, tree]).permutation(len(x))
    order = mixed[np.argsort(codes[mixed], kind="stable")]
    starts, sizes = _runs(codes[order])
    parts = sizes // (4 * block) + 1
    part = (np.arange(len(x)) - np.repeat(starts, sizes)) * np.repeat(parts, sizes) // np.repeat(sizes, sizes)
    return order, codes[order], *_runs(codes[order] * (len(x) + 1) + part)


def _bits(n: int, block: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n / block)))))


def _met(x: np.ndarray, members: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int, farthest: np.ndarray, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the members of each group have in each other: pairs nearer than an end's farthest neighbour so far, the k nearest of each.
    Of members that aren't new, pairs have met before. Groups of like sizes are taken together."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    widths = -(-sizes // 8) * 8
    for width in np.unique(widths):
        alike = np.flatnonzero(widths == width)
        step = max(1, (1 << 20) // int(width * max(width, x.shape[1])))
        for i in range(0, len(alike), step):
            group = alike[i : i + step]
            inside = np.arange(width) < sizes[group][:, None]
            at = np.where(inside, starts[group][:, None] + np.arange(width), starts[group][:, None])
            ids = members[at]
            # Relative to one of them, so that the small distances of a group far from zero keep their precision.
            v = x.take(ids, axis=0)
            v -= v[:, :1].copy()
            norms = np.einsum("gij,gij->gi", v, v)
            squares = (v * -2) @ v.transpose(0, 2, 1)
            squares += np.where(inside, norms, np.inf)[:, None, :]
            squares += norms[:, :, None]
            squares[:, np.arange(width), np.arange(width)] = np.inf
            hit = squares < np.where(inside, farthest[ids], -np.inf)[:, :, None]
            if new is not None:
                fresh = new[at]
                hit &= fresh[:, :, None] | fresh[:, None, :]
            if k < width and np.count_nonzero(hit) > k * np.count_nonzero(inside):
                squares[~hit] = np.inf
                hit &= squares <= np.partition(squares, k - 1, axis=2)[:, :, k - 1 : k]
            cells = np.flatnonzero(hit)
            row, b = np.divmod(cells, width)
            out.append((ids.ravel().take(row), ids[row // width, b], np.maximum(squares.ravel().take(cells), 0)))
    a, b, squares = (np.concatenate(c) for c in zip(*out, strict=True))
    return a, b, squares


def _nearest(near: np.ndarray, squares: np.ndarray, a: np.ndarray, b: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of each node, each once, with links a, b joined in; and which of them are new."""
    n, k = near.shape
    node, rank = np.nonzero(near >= 0)
    a, b, found = np.r_[node, a], np.r_[near[node, rank], b], np.r_[squares[node, rank], found]
    # Stable, so that a pair's old link comes before new ones.
    pairs = a * n + b
    order = np.argsort(pairs, kind="stable")
    pairs = pairs.take(order)
    first = order[np.r_[True, pairs[1:] != pairs[:-1]]] if len(order) else order
    # Bits of floats that aren't negative are in the floats' order.
    first = first[np.argsort((a[first] << 32) | found[first].view(np.int32).astype(np.int64), kind="stable")]
    a = a.take(first)
    rank = np.arange(len(a)) - np.searchsorted(a, np.arange(n)).take(a)
    top = np.flatnonzero(rank < k)
    first, a, rank = first.take(top), a.take(top), rank.take(top)
    b, found, old = b.take(first), found.take(first), first < len(node)
    near, squares, new = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32), np.zeros((n, k), bool)
    near[a, rank], squares[a, rank], new[a, rank] = b, found, ~old
    return near, squares, new


def _both_ways(near: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links ``(node, end, new)`` of both directions, each once, in order."""
    n = len(near)
    node, rank = np.nonzero(near >= 0)
    end, fresh = near[node, rank], new[node, rank]
    links = np.sort(np.r_[node * n + end, end * n + node] * 2 + np.r_[fresh, fresh])
    links = links[np.r_[links[1:] >> 1 != links[:-1] >> 1, True]] if len(links) else links
    return *np.divmod(links >> 1, n), (links & 1).astype(bool)


def _meetings(near: np.ndarray, new: np.ndarray, hub: int, chance: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends that meet at each node, which of them are new, and starts and sizes of meetings. A hub's incoming links are dealt out in
    parts, each with all of its own links."""
    node, end, fresh = _both_ways(near, new)
    starts, sizes = _runs(node)
    some = np.add.reduceat(fresh, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    large = some & (sizes > hub + near.shape[1])
    ends, fresher, more = [end], [fresh], []
    for s, m in zip(starts[large], sizes[large], strict=True):
        mine = np.isin(end[s : s + m], near[node[s]])
        own, others = s + np.flatnonzero(mine), chance.permutation(s + np.flatnonzero(~mine))
        for part in np.array_split(others, len(others) // hub + 1):
            ends.append(end[np.r_[own, part]])
            fresher.append(fresh[np.r_[own, part]])
            more.append(len(own) + len(part))
    kept = some & ~large
    return np.concatenate(ends), np.concatenate(fresher), np.r_[starts[kept], len(end) + np.cumsum([0, *more])[:-1]].astype(np.int64), np.r_[sizes[kept], more].astype(np.int64)


def _descend(x: np.ndarray, k: int, trees: int, block: int, rounds: int | None, hub: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector of a shard the k nearest found, -1 where there are fewer, and their squared distances."""
    n = len(x)
    near, squares, new = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32), np.zeros((n, k), bool)
    for tree in range(trees):
        order, _, starts, sizes = _blocks(x, seed, tree, block)
        near, squares, new = _nearest(near, squares, *_met(x, order, starts, sizes, k, squares[:, -1]))
    new, age, chance = near >= 0, 0, np.random.default_rng(seed)
    while rounds is None or age < rounds:
        age += 1
        ends, fresh, starts, sizes = _meetings(near, new, hub, chance)
        near, squares, new = _nearest(near, squares, *_met(x, ends, starts, sizes, k, squares[:, -1], fresh))
        if np.count_nonzero(new) <= CHANGED * np.count_nonzero(near >= 0):
            break
    return near, squares


_INDEX = "shard long, place int, node long, point binary, near array<int>, squares array<float>, block int"


def _graphs(k: int, trees: int, block: int, rounds: int | None, hub: int, seed: int):
    """The rows of each shard with their places in it and links to places."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, group in _groups(source, "shard"):
            group = group.combine_chunks()
            nodes, points = group.column("node").to_numpy(), group.column("point").chunk(0)
            near, squares = _descend(_floats(points), k, trees, block, rounds, hub, seed)
            near, places = near.astype(np.int32), np.arange(len(nodes), dtype=np.int32)
            for i in range(0, len(nodes), 8192):
                part = slice(i, i + 8192)
                there = near[part] >= 0
                at = pa.array(np.r_[0, np.cumsum(there.sum(1))].astype(np.int32))
                links = [pa.ListArray.from_arrays(at, pa.array(c[there])) for c in (near[part], squares[part])]
                columns = [pa.array(np.full(len(there), shard)), pa.array(places[part]), pa.array(nodes[part]), points[i : i + 8192], *links, pa.array(np.full(len(there), block, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "place", "node", "point", "near", "squares", "block"])

    return batches


def build(nodes: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, block: int = BLOCK, rounds: int | None = None, hub: int = HUB, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The graph ``(node, near, distance)`` of nodes ``(node, vector)``, and the nodes with ``shard``, ``point`` and their links. Distances
    there are squares, of points.

    A shard's graph ends when a round changes at most ``CHANGED`` of its links, or after ``rounds`` if given."""
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("node", "vector", _size()).join(F.broadcast(_sizes(nodes)), "size")
    dealt = dealt.select("node", "vector", _shard(F.pmod(F.xxhash64("node"), F.col("shards"))))
    points = dealt.mapInArrow(_points(nodes), "node long, shard long, point binary")
    found = points.repartition(shuffles, "shard").sortWithinPartitions("shard", "node").mapInArrow(_graphs(k, trees, block, rounds, hub, seed), _INDEX)
    coded = written(found, "nn-index")
    links = coded.select("shard", "node", F.explode(F.arrays_zip("near", "squares")).alias("link"))
    ends = coded.select("shard", F.col("place").alias("end"), F.col("node").alias("near"))
    links = links.select("shard", "node", F.col("link.near").alias("end"), F.col("link.squares").alias("distance"))
    return links.join(ends, ["shard", "end"]).select("node", "near", "distance"), coded


def _shard(part: Column) -> Column:
    return (F.col("size").cast("long") * (1 << 32) + part).alias("shard")


class _Shard:
    """A shard's vectors and links, of its rows in the order of their places, and greedy search in them."""

    def __init__(self, pieces: list[pa.RecordBatch], seed: int):
        rows = pa.Table.from_batches(pieces).combine_chunks()
        self.nodes, self.x = rows.column("node").to_numpy(), _floats(rows.column("point").chunk(0))
        self.block, self.seed = rows.column("block")[0].as_py(), seed
        links = rows.column("near").chunk(0)
        end = links.flatten().to_numpy().astype(np.int64)
        node, n = np.repeat(np.arange(len(self.nodes)), links.value_lengths().to_numpy()), len(self.nodes)
        both = np.sort(np.r_[node * n + end, end * n + node])
        node, self.ends = np.divmod(both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both, n)
        self.first = np.searchsorted(node, np.arange(n + 1))
        self.trees = [_blocks(self.x, seed, t, self.block) for t in range(STARTS)]

    def starts(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of queries and nodes: those of a query's blocks, or of one part of each, and a few others."""
        every, n = np.arange(len(queries)), len(self.x)
        spread = np.unique(np.random.default_rng(self.seed).integers(0, n, SPREAD))
        asked, found = [np.repeat(every, len(spread))], [np.tile(spread, len(queries))]
        for tree, (order, codes, starts, sizes) in enumerate(self.trees):
            own = _codes(queries, self.seed, tree, _bits(n, self.block))
            heads = codes[starts]
            low, high = np.searchsorted(heads, own), np.searchsorted(heads, own, "right")
            part = np.minimum(low + every % np.maximum(high - low, 1), len(starts) - 1)
            count = np.where(high > low, sizes[part], 0)
            asked.append(np.repeat(every, count))
            found.append(order[_ranges(starts[part], count)])
        return np.concatenate(asked), np.concatenate(found)

    def search(self, queries: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the beam's nodes, nearest first and -1 where there are none left, and their squared distances."""
        n, m = len(self.x), len(queries)
        beam = min(beam, n)
        held, squares = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen, last = np.zeros(m * n, bool), np.empty(m * n, np.int32)
        asked, at = self.starts(queries)
        while True:
            pairs = asked * n + at
            fresh = np.flatnonzero(~seen.take(pairs))
            pairs, number = pairs.take(fresh), np.arange(len(fresh), dtype=np.int32)
            seen[pairs] = True
            last[pairs] = number
            fresh = fresh[last.take(pairs) == number]
            asked, at = asked.take(fresh), at.take(fresh)
            found = np.empty(len(at), np.float32)
            for i in range(0, len(at), 4096):
                far = self.x.take(at[i : i + 4096], axis=0) - queries.take(asked[i : i + 4096], axis=0)
                found[i : i + 4096] = np.einsum("ij,ij->i", far, far)
            nearer = found < squares[asked, -1]
            asked, at, found = asked[nearer], at[nearer], found[nearer]
            if len(at):
                order = np.argsort(asked, kind="stable")
                asked, at, found = asked[order], at[order], found[order]
                count = np.bincount(asked, minlength=m)
                rank = np.arange(len(at)) - (np.cumsum(count) - count)[asked]
                more, close = np.full((m, count.max()), -1, np.int64), np.full((m, count.max()), np.inf, np.float32)
                more[asked, rank], close[asked, rank] = at, found
                held, squares, done = np.c_[held, more], np.c_[squares, close], np.c_[done, more < 0]
                order = np.argsort(squares, axis=1)[:, :beam]
                held, squares, done = (np.take_along_axis(c, order, 1) for c in (held, squares, done))
            front = ~done & (np.cumsum(~done, axis=1) <= max(expand, beam // 8))
            if not front.any():
                return held, squares
            done |= front
            asked, place = np.nonzero(front)
            node = held[asked, place]
            count = self.first[node + 1] - self.first[node]
            asked, at = np.repeat(asked, count), self.ends.take(_ranges(self.first[node], count))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as counted."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _wider(beam: int) -> int:
    """The next beam: half as wide again."""
    return beam + max(1, beam // 2)


def _probed(probes: dict[int, np.ndarray], k: int, first: int, expand: int, seed: int):
    """The true k nearest nodes of each probe in each shard, by brute force, and the first beam from which on a search finds each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(source, "shard"):
            shard = _Shard(group.to_batches(), seed)
            n = len(shard.x)
            ids = np.array([i for i, v in probes.items() if len(v) == shard.x.shape[1]], np.int64)
            for i in range(0, len(ids), AT_ONCE):
                own = ids[i : i + AT_ONCE]
                q = np.array([probes[j] for j in own])
                true, far = np.zeros((len(own), min(k, n)), np.int64), np.full((len(own), min(k, n)), np.inf, np.float32)
                for j, v in enumerate(q):
                    apart = shard.x - v
                    squares = np.where(shard.nodes == own[j], np.inf, np.einsum("ij,ij->i", apart, apart))
                    true[j] = np.argsort(squares)[:k] if n <= 4 * k else (some := np.argpartition(squares, k)[:k])[np.argsort(squares[some])]
                    far[j] = squares[true[j]]
                there, needed, beam = np.isfinite(far), np.zeros(true.shape, np.int64), first
                while True:
                    held, _ = shard.search(q, beam, expand)
                    hit = np.array([np.isin(t, h) for t, h in zip(true, held, strict=True)]).reshape(true.shape)
                    needed = np.where(hit, np.where(needed > 0, needed, beam), 0)
                    if beam >= n or np.count_nonzero(hit & there) >= (1 + RECALL) / 2 * np.count_nonzero(there):
                        break
                    beam = _wider(beam)
                j, r = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(own[j]), pa.array(far[j, r]), pa.array(needed[j, r])], ["query_id", "square", "beam"])

    return batches


def _wide_enough(shards: DataFrame, nodes: DataFrame, points, k: int, expand: int, seed: int) -> int:
    """The first beam, from ``BEAM`` on by halves, with which probes find ``RECALL`` of their true ``k`` nearest nodes."""
    some = nodes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(PROBES).mapInArrow(points, "node long, point binary").collect()
    probes = {r.node: np.frombuffer(r.point, np.float32) for r in some}
    near = shards.mapInArrow(_probed(probes, k, BEAM, expand, seed), "query_id long, square float, beam long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "beam"))
    needed = near.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy("beam").agg(F.count("*").alias("hits")).collect()
    found, every = {r.beam: r.hits for r in needed if r.beam > 0}, sum(r.hits for r in needed)
    hits, beam = 0, BEAM
    for beam in sorted(found):
        hits += found[beam]
        if hits >= RECALL * every:
            return beam
    if every:
        warnings.warn(f"probes find {hits} of {every} neighbours, and no wider beam reaches more", stacklevel=3)
    return beam


def _searched(k: int, beam: int, expand: int, seed: int):
    """The nearest few nodes of each query in each shard. A shard's own rows come before its queries, which may be many."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for at, piece in _pieces(source, "shard"):
            if at != now:
                now, held, shard = at, [], None
            own = piece.column("query_id").null_count
            if own:
                held.append(piece.slice(0, own))
            if own == len(piece) or not held:
                continue
            shard = shard or _Shard(held, seed)
            ids, q = piece.column("query_id").slice(own).to_numpy(), _floats(piece.column("point").slice(own))
            for i in range(0, len(q), AT_ONCE):
                places, squares = (c[:, :k] for c in shard.search(q[i : i + AT_ONCE], max(beam, k), expand))
                j, r = np.nonzero(places >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + AT_ONCE][j]), pa.array(shard.nodes[places[j, r]]), pa.array(squares[j, r])], ["query_id", "node", "square"])

    return batches


def _measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of queries and nodes, in double precision."""
    for batch in source:
        for (own, q), (_, x) in zip(_doubles(batch.column("query")), _doubles(batch.column("vector")), strict=True):
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("members").take(at), pa.array(np.sqrt(((q - x) ** 2).sum(1)))], ["query_id", "members", "score"])


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, coded: DataFrame, k: int = 10, beam: int | None = None, expand: int = EXPAND, seed: int = 7) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query ``(query_id, query)`` the ``k`` nearest found; a query's own id isn't a candidate.

    ``nodes`` are those of ``nodes_of``, ``graph`` and ``coded`` what ``build`` returned; links are read from ``coded``, which has a node's
    all in one row. Without ``beam`` it is found with probes."""
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _points(nodes)
    queries = queries.select("query_id", F.col("query").alias("vector")).mapInArrow(_packed, "query_id long, vector binary")
    shards = coded.select("shard", "place", "node", "point", "near", "block")
    if beam is None:
        beam = _wide_enough(shards.repartition(shuffles, "shard").sortWithinPartitions("shard", "place"), nodes, points, k, expand, seed)
    asked = queries.select("query_id", _size(), "vector").mapInArrow(points, "query_id long, size int, point binary")
    asked = asked.join(F.broadcast(_sizes(nodes)), "size").select("query_id", "point", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("part"))
    both = shards.unionByName(asked.select("query_id", "point", _shard(F.col("part"))), allowMissingColumns=True)
    both = both.repartition(shuffles, "shard").sortWithinPartitions("shard", F.asc_nulls_first("query_id"), "place")
    # Points are of single precision, so a few more than asked for are measured; one is the query's own node.
    few = 2 * k + 1
    near = both.mapInArrow(_searched(few, beam, expand, seed), "query_id long, node long, square float")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "node"))
    near = written(near.withColumn("_rank", rank).where(F.col("_rank") <= few).select("query_id", "node").distinct(), "nn-near")
    full = near.join(likely_in(nodes, near, "node"), "node").join(queries.select("query_id", F.col("vector").alias("query")), "query_id").where(F.octet_length("query") == F.octet_length("vector"))
    scored = full.select("query_id", "query", "vector", "members").mapInArrow(_measure, "query_id long, members array<long>, score double")
    members = scored.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    members = members.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return members.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    nodes = written(nodes_of(vectors, 10), "nn-vectors-of")
    graph, coded = build(nodes)
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct()
    return search(queries, nodes, graph, coded)
