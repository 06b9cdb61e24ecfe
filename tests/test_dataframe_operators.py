"""Operators against plain Python versions, with nulls, ties, hot groups and plans that stay linear."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lodeframe import storage
from lodeframe.operators import graphs as G
from lodeframe.operators import joins as J
from lodeframe.operators import ordered as O


def test_bounds_against_plain_version(spark):
    random.seed(1)
    held = [random.randrange(500) for _ in range(120)] + [None]
    asked = [random.randrange(-20, 540) for _ in range(200)] + [None]
    df = O.bounds(spark.createDataFrame([(k,) for k in held], "k long"), spark.createDataFrame([(p,) for p in asked], "p long"), "k", "p")
    keys = sorted({k for k in held if k is not None})
    plain = [(p, *(min((k for k in keys if p is not None and f(k, p)), default=None) for f in (int.__ge__, int.__gt__))) for p in asked]
    assert sorted(map(tuple, df.select("p", "lower", "upper").collect()), key=repr) == sorted(plain, key=repr)
    frames = df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in frames.lower() and "currentrow" in frames.lower()


def test_neighbours_without_groups(spark):
    keys = list(range(0, 3000, 7))
    random.shuffle(keys)
    df = O.neighbours(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    keys.sort()
    plain = list(zip(keys, [None, *keys[:-1]], [*keys[1:], None], strict=True))
    assert sorted(map(tuple, df.select("k", "predecessor", "successor").collect())) == plain
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_lru_against_plain_cache(spark):
    random.seed(2)
    rows = [(i, random.choice([1, 1, 1, 2]), random.choice([None, *range(9)])) for i in range(600)]
    got = {r.i: r.hit for r in O.lru_hits(spark.createDataFrame(rows, "i long, u long, k long").withColumn("hit", F.lit("clash")), "u", ["i"], "k", 4).collect()}
    caches: dict = {}
    for i, u, k in rows:
        cache = caches.setdefault(u, OrderedDict())
        assert got[i] == (k in cache)
        cache[k] = None
        cache.move_to_end(k)
        while len(cache) > 4:
            cache.popitem(last=False)


def test_slot_map_against_plain_replay(spark):
    random.seed(3)
    rows = [(u, i, random.choice(["insert", "insert", "erase"])) for u in (1, 2) for i in range(80)]
    got = {r.u: (r.live, r.full) for r in O.slot_ids(spark.createDataFrame(rows, "u long, i long, op string"), "u", ["i"], "op", 5).collect()}
    for u in (1, 2):
        generation, free, live, full = [1] * 5, [4, 3, 2, 1, 0], [], 0
        for _, _, op in (r for r in rows if r[0] == u):
            if op == "insert" and free:
                slot = free.pop()
                live.append((generation[slot] << 16) + slot)
            elif op == "insert":
                full += 1
            elif live:
                slot = live.pop(0) & 0xFFFF
                generation[slot] += 1
                free.append(slot)
        assert got[u] == (live, full)


def test_overlap_against_all_pairs(spark):
    random.seed(4)
    spans = [(i, random.randrange(3), lo := random.randrange(-300, 300), lo + random.randrange(-2, 40)) for i in range(150)]
    queries, stored = spans[:60], spans[60:]
    cols = "id long, g long, low long, high long"
    q, s = spark.createDataFrame(queries, cols), spark.createDataFrame(stored, cols)
    meets = lambda a, b: a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
    got = {r.id for r in J.has_overlap(q, s, 50, "id", on=("g",)).collect()}
    assert got == {a[0] for a in queries if any(a[1] == b[1] and meets(a, b) for b in stored)}
    assert {r.id for r in J.has_overlap(q, s, 50, "id").collect()} == {a[0] for a in queries if any(meets(a, b) for b in stored)}


def test_as_of_breaks_ties(spark):
    left = spark.createDataFrame([(1, 5), (1, 70), (2, 5)], "u long, t long")
    right = spark.createDataFrame([(1, 5, v) for v in (3, 9, 1, 7)], "u long, s long, v long").repartition(4)
    assert sorted((r.u, r.t, r.v) for r in J.as_of(left, right, "t", "s", ("u",), ("v",), 10).collect() if r.u == 1) == [(1, 5, 9), (1, 70, 9)]


def test_longest_common_prefix_against_plain_version(spark):
    random.seed(5)
    texts = ["".join(random.choice("aé😀~") for _ in range(random.randrange(6))) for _ in range(60)]
    keys, queries = [*texts[:30], None], [*texts[30:], None, "", "x" * 5000]
    got = J.longest_common_prefix(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([(q,) for q in queries], "q string"), "k", "q")

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    plain = [(q, max(common(q, k) for k in keys if k is not None) if q is not None else 0) for q in queries]
    assert sorted(map(tuple, got.select("q", "common").collect()), key=repr) == sorted(plain, key=repr)


def test_closure_and_components_against_plain_versions(spark):
    random.seed(6)
    edges = list({(random.randrange(30), random.randrange(30)) for _ in range(40)})
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({n for e in edges for n in e} | {77})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    values = spark.createDataFrame([(n, [n % 4, n % 7]) for n in nodes], "node long, items array<long>")
    got = {r.node: r["values"] for r in G.closure_union(df, values).collect()}
    assert got == {n: sorted({v for m in reach[n] for v in (m % 4, m % 7)}) for n in nodes}
    weak = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            weak[a] = weak[b] = min(weak[a], weak[b])
    assert {r.node: r.component for r in G.components(df).collect()} == {n: weak[n] for n in nodes if n != 77}
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.components(chain).agg(F.max("component")).first()[0] == 0
    assert G.components(df.limit(0)).count() == 0


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace as Has

    cluster = Has(sparkContext=Has(master="spark://far:7077", applicationId="a"), conf=Has(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(cluster)


def test_traversals_against_recursion(spark):
    tree = O.heap_tree(spark.createDataFrame([(g, i) for g, n in ((1, 13), (2, 1), (3, 8)) for i in range(n)], "g long, i long"), "g", ["i"])

    def walk(node, n, kind):
        if node > n:
            return []
        left, right = walk(2 * node, n, kind), walk(2 * node + 1, n, kind)
        return {"pre": [node, *left, *right], "in": [*left, node, *right], "post": [*left, *right, node]}[kind]

    for kind in ("pre", "in", "post"):
        got: dict = {}
        for r in O.traversal(tree, "g", kind).orderBy("g", "place").collect():
            got.setdefault(r.g, []).append(r.node)
        assert got == {g: walk(1, n, kind) for g, n in ((1, 13), (2, 1), (3, 8))}


def test_chunks_of_streams(spark):
    from lodeframe.streaming.chunks import deflate_chunks, inflate_chunks

    rows = [("a", i, bytes([i]) * 1000) for i in range(5)] + [("b", 0, None), (None, 1, b"x")]
    df = spark.createDataFrame(rows, "k string, n long, d binary").repartition(3)
    packed = deflate_chunks(df, "k", "n", "d")
    back = sorted(((r.k, r.n, bytes(r.d)) for r in inflate_chunks(packed, "k", "n", "d").collect() if r.n is not None), key=repr)
    assert back == sorted(((k, n, d or b"") for k, n, d in rows), key=repr)
    with pytest.raises(Exception, match="cut off"):
        inflate_chunks(packed.where("n IS NOT NULL"), "k", "n", "d").collect()
    with pytest.raises(Exception, match="has ended"):
        inflate_chunks(packed.unionByName(packed.where("n = 0").withColumn("n", F.lit(None).cast("long"))), "k", "n", "d").collect()
    assert deflate_chunks(df.limit(0), "k", "n", "d").count() == 0


def test_cursors_against_fields():
    from lodeframe.functions import bits as B

    random.seed(8)
    for order in B.BitOrder:
        widths = [random.randrange(1, 20) for _ in range(30)]
        values = [random.randrange(1 << w) for w in widths]
        out = B.BitWriter(order)
        for v, w in zip(values, widths, strict=True):
            out.write(v, w)
        assert out.buffer() == B.write_bits(values, widths, order)
        cursor = B.BitReader(out.buffer(), order)
        assert [(cursor.peek(w), cursor.read(w)) for w in widths] == [(v, v) for v in values]
        cursor.align()
        assert cursor.eof
        with pytest.raises(ValueError):
            cursor.read(1)
        with pytest.raises(ValueError):
            cursor.seek(-1)


def test_penta_inverses_and_schemas(spark):
    from lodeframe.functions import schemas as S
    from lodeframe.functions import tower as N

    two = N.of(2.0)
    assert N.penta_log(N.pentate(two, 2.0), two) == pytest.approx(2.0, abs=1e-6)
    assert N.penta_root(N.pentate(two, 2.0), 2.0) == pytest.approx(2.0, abs=1e-6)
    row = spark.sql("SELECT named_struct('a', 1, 'b', 'x') AS s").select(S.field_of(F.col("s"), "b")).first()
    assert row[0] == "x" and set(S.measure(lambda: None, 3)) == {"min", "max", "avg", "stddev", "total", "runs"}


def test_strong_components_of_a_long_way(spark, monkeypatch):
    """Rounds don't follow a way node by node from its least end."""
    tables, plain = [], G.kept_counting
    monkeypatch.setattr(G, "kept_counting", lambda *a: tables.append(1) or plain(*a))
    edges = spark.createDataFrame([(i, i + 1) for i in range(18)] + [(18, 17), (30, 30)], "src long, dst long")
    found = {r.node: r.component for r in G.strong_components(edges).collect()}
    assert found == {i: i for i in range(18)} | {18: 17, 30: 30}
    assert len(tables) < 100


def test_prefixes_against_plain_version(spark):
    keys = ["", "a", "ab", "abc", "abcdef", "abcdefghij", "abcdefghxx", "b", "ab", None]
    asked = ["", "a", "abc", "abcdefgh", "abcdefghij", "abcdefghijk", "c", None]
    df = J.prefix_join(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([(p,) for p in asked], "p string"), "k", "p", 8)
    plain = [(k, p) for k in keys for p in asked if k is not None and p is not None and k.startswith(p)]
    assert sorted(map(tuple, df.select("k", "p").collect())) == sorted(plain)
    # The heads, which are more than Spark's estimate of them, aren't broadcast.
    few, many = (spark.range(n).select(F.col("id").cast("string").alias(c)) for n, c in ((10, "k"), (1000, "p")))
    plan = J.prefix_join(few, many, "k", "p", 8)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
