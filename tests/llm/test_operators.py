"""The operators against brute force, exact round trips and held-out accuracy, with the edge cases that their docstrings define."""

import hashlib
import pathlib
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import components, decontaminate, language_id, near_dedup, neighbours, pii, queries, reply_trees, sentencepiece_fst, substring_dedup, token_files, url_filter
from lodeframe.llm.common import likely_in, text_buffers
from lodeframe.llm.fm_index import FMIndex

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "  ", "a  b\n\nc", "x " * 3000, "Ünï 日本 \x1c \x00", "<|endoftext|> ok", "one", "a<|endoftext|>.<|endoftext|>", "<|endof text|>"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rows_of(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return rows.withColumns({"score": F.lit("clash"), "hits": F.lit(1), "n_tokens": F.lit("x")}) if extra else rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in "documents pages benchmark conversations".split():
        con.execute(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    names = [x[0] for x in con.execute(queries.ORACLES[name]).description]
    true = con.fetchall()
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(true, key=repr)


# 1: token files


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(name)
    source = docs.select("doc_id", "text").unionByName(rows_of(spark, ODD).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    path = f"file://{tmp_path}/tokens"
    token_files.write(source, path, name)
    start = 0
    found = {r.doc_id: r for r in token_files.layout(spark, path).collect()}
    for row in sorted(source.collect(), key=lambda r: r.doc_id):
        ids = own.encode(row.text or "", add_special_tokens=False).ids + [2]
        got = found[row.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_files.lookup(spark, path, [3, 10_001]).orderBy("doc_id").collect()] == [3, 10_001]
    assert "doc_id" in str(token_files.lookup(spark, path, [3])._jdf.queryExecution().executedPlan())
    # A look-up reads the row groups that statistics and Bloom filters leave, not the file.
    many = spark.range(5000).select((F.col("id") * 3).alias("doc_id"), F.lit("some text").alias("text"))
    token_files.write(many, path + "-many", name, partitions=1)
    asked = token_files.lookup(spark, path + "-many", [3 * 1234])
    assert asked.count() == 1
    plan = asked._jdf.queryExecution().executedPlan()
    asked._jdf.queryExecution().toRdd().count()
    scan = plan.collectLeaves().head()
    assert 1 <= scan.metrics().get("numOutputRows").get().value() <= 1000
    own.encode_special_tokens = True
    plain = {r.doc_id: r.tokens for r in token_files.encode(rows_of(spark, ODD), name, specials_as_text=True).collect()}
    assert plain == {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)}
    token_files.write(empty(spark), path + "-none", name)
    assert token_files.layout(spark, path + "-none").count() == 0


# 2: neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    rows = [(i, x[i].tolist()) for i in range(400)] + [(1000 + i, x[0].tolist()) for i in range(30)] + [(1, x[1].tolist()), (2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0, 2.0])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    nodes = neighbours.nodes_of(vectors, 5)
    graph, coded = neighbours.build(nodes, k=8, trees=6, block=32, rounds=2)
    asked = {0: x[0], 7: x[7], 5000: x[9] + 0.01}
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "query_id long, query array<double>")
    found: dict = {}
    for r in neighbours.search(queries, nodes, graph, coded, k=5, beam=60, expand=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    every = {i: np.array(v) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    hits = 0
    for q, v in asked.items():
        true = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in every.items() if i != q)[:5]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(s - np.sqrt(((every[i] - v) ** 2).sum())) < 1e-12 for _, i, s in got)
        hits += len({i for _, i in true} & {i for _, i, _ in got})
    assert sorted(found[0])[0][1:] == (1000, 0.0)  # a copy of the query, the smallest id first
    assert hits >= 0.9 * 15
    none = neighbours.nodes_of(vectors.limit(0), 5)
    graph, coded = neighbours.build(none)
    assert neighbours.search(queries, none, graph, coded).count() == 0


def test_neighbours_graph_converges_and_beam_follows_recall(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(3000, 8))
    nodes = neighbours.nodes_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 10)
    graph, coded = neighbours.build(nodes, k=8, trees=2, block=8)  # blocks this few leave much to the rounds
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:]
    links = {(r.node, r.near) for r in graph.collect()}
    share = len(links & {(i, int(j)) for i in range(3000) for j in near[i, :8]}) / (8 * 3000)
    assert share >= 0.9
    monkeypatch.setattr(neighbours, "BEAM", 10)
    asked = range(0, 3000, 60)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in asked], "query_id long, query array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.search(queries, nodes, graph, coded, expand=4).collect()}
    assert len(found & {(i, int(j)) for i in asked for j in near[i, :10]}) >= 0.9 * 10 * len(asked)


def test_neighbours_query_recall(spark):
    """The registered query with its defaults, against brute force."""
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding)) for r in neighbours.usable(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found: dict = {}
    for r in neighbours.neighbours_query(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        hits += len({int(ids[i]) for i in order} & {i for _, i, _ in got})
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11))
        assert all(s == pytest.approx(far[ids == i][0], abs=1e-12) for _, i, s in got)
    assert hits >= 0.9 * 10 * len(found)


def test_neighbours_in_shards_take_few_jobs(spark, monkeypatch):
    """Rounds of the graph and of the search run inside tasks: jobs don't grow with them, and all shards answer, far from zero too."""
    monkeypatch.setattr(neighbours, "LEAST", 500, raising=False)
    x = np.random.default_rng(6).normal(size=(2400, 8)) + 1000
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, 2400, 60)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in asked], "query_id long, query array<double>")
    context = spark.sparkContext
    context.setJobGroup("neighbours", "neighbours")
    nodes = neighbours.nodes_of(vectors, 10)
    graph, coded = neighbours.build(nodes)
    rows = neighbours.search(queries, nodes, graph, coded).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("neighbours"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 60
    assert coded.select("shard").distinct().count() == 4 and coded.count() == 2400
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:11]
    assert len(rows) == 10 * len(asked)
    assert len({(r.query_id, r.vec_id) for r in rows} & {(i, int(j)) for i in asked for j in near[i]}) >= 0.9 * len(rows)
    # Cut blocks and hubs lose no pair of a node's own links and the ends of others.
    links = np.full((50, 2), -1)
    links[1:, 0], links[0] = 0, [1, 2]
    ends, _, starts, sizes = neighbours._meetings(links, links >= 0, 10, np.random.default_rng(0))
    parts = [set(ends[a : a + n].tolist()) for a, n in zip(starts, sizes, strict=True) if n > 1]
    assert len(parts) == 5 and all({1, 2} <= p for p in parts) and set().union(*parts) == set(range(1, 50))


# 3: URL filter


def test_url_filter_against_plain_version(spark):
    random.seed(3)
    hosts = ["a.example.com", "b.example.com", "example.org", "x.y.example.org"]
    keys = ["host:a.example.com", "domain:example.org", "domain:com", "url:http://a.example.com/p", None]
    entries = [(random.choice(keys), random.choice(range(0, 400, 7)), random.random() < 0.6) for _ in range(60)]
    urls = [f"http://{h}/p" for h in hosts] + ["HTTP://u@A.Example.com.:80/q#x", "nonsense", "", None]
    caps = [(i, random.choice(urls), random.choice([None, *range(0, 420, 11)])) for i in range(300)]
    day = "timestamp'2024-01-01' + make_interval(0, 0, 0, d)"
    e = spark.createDataFrame(entries, "key string, d int, listed boolean").selectExpr("key", f"{day} AS at", "listed")
    c = spark.createDataFrame([*caps, caps[0]], "page_id long, url string, d int").selectExpr("page_id", "url", f"{day} AS fetch_ts", "d", "'clash' AS blocked")
    got = {r.page_id: (r.host, r.blocked, r.listed_key) for r in url_filter.apply(c, url_filter.validity(e)).collect()}
    for i, url, d in caps:
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", (url or "").lower())
        host = m[1].rstrip(".") if m and m[1] else None
        own = ([f"url:{url}"] if url is not None else []) + ([f"host:{host}"] + [f"domain:{'.'.join(host.split('.')[k:])}" for k in range(len(host.split(".")))] if host else [])
        on = []
        for k in own:
            past = [(t, listed) for kk, t, listed in entries if kk == k and d is not None and t <= d]
            if past and any(listed for t, listed in past if t == max(past)[0]):
                on.append(k)
        first = min(on, key=lambda k: (0 if k.startswith("url:") else 1 if k.startswith("host:") else 2, -len(k), k)) if on else None
        assert got[i] == (host, bool(on), first)
    assert url_filter.apply(c.limit(0), url_filter.validity(e.limit(0))).count() == 0


def test_url_filter_with_far_times(spark):
    times = ["0001-01-01", "1969-12-31", "1970-01-01", "2024-02-29", "9999-12-30"]
    e = spark.createDataFrame([("host:a.b", "1969-12-31", True), ("host:a.b", "2024-02-29", False), ("host:c.d", "0001-01-01", True)], "key string, at string, listed boolean")
    c = spark.createDataFrame([(i, f"http://{h}/" + "x" * 100_000, t) for i, (h, t) in enumerate((h, t) for h in ("a.b", "c.d") for t in times)], "page_id long, url string, fetch_ts string").withColumn("fetch_ts", F.col("fetch_ts").cast("timestamp"))
    dealt = url_filter._dealt(url_filter.validity(e))
    assert dealt.count() <= 10
    assert [r.blocked for r in url_filter.apply(c, url_filter.validity(e)).orderBy("page_id").select("blocked").collect()] == [False, True, True, False, False] + [True] * 5


# 4: substring removal


def brute_removal(rows, window):
    words, first = [(d, WORD.findall(t or "")) for d, t in rows], {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "gram", "shard_words"), [(6, 3, 200), (6, 2, 20), (5, 1, 1_000_000)])
def test_substring_removal(spark, window, gram, shard_words):
    random.seed(5)
    base = [" ".join(random.choice("abcd") for _ in range(25)) for _ in range(4)]
    rows = [(None, base[0]), (5, base[0]), (5, base[0]), (3, base[0]), (9, None), (10, ""), (11, "a\x1cb " * 9)]
    for i in range(50):
        t = " ".join(random.choice([random.choice(base)[random.randrange(6) :], " ".join(random.choice("abcdxyz") for _ in range(random.randrange(15)))]) for _ in range(random.randrange(4)))
        rows.append((random.choice([i, i, i - 1]), random.choice([t, t + "\n"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = substring_dedup.dedup(df, window, gram, shard_words=shard_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_removal(rows, window)


def test_substring_query(spark, docs):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup_query(spark, DIR).collect()), key=repr)
    assert got == brute_removal([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(1)
    for cap in (1, 3, 5):
        for _ in range(15):
            bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 5))])
            text, values = rng.integers(1, 4, bounds[-1]), rng.permutation(5)
            seqs = [text[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            query = rng.integers(1, 5, 20)
            lengths, least = FMIndex(text, bounds, values, cap).match(query, np.array([0, 12, 20]))
            for p in range(20):
                end = 12 if p < 12 else 20
                for n in range(min(cap, end - p), -1, -1):
                    have = [v for v, s in zip(values, seqs, strict=True) if n and any(s[o : o + n] == query[p : p + n].tolist() for o in range(len(s)))]
                    if have or not n:
                        break
                assert lengths[p] == n and (n < cap or least[p] == min(have))


# 5: language ID


def test_language_id(spark, docs):
    got = language_id.language_id_query(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)
    model = language_id.fit(docs.select("text", "lang"))
    odd = language_id.predict(rows_of(spark, [*ODD, "1234 !?", "qxzj vwkq zzxq jjqw xkcd qqqq wxyz zxcv" * 20], extra=True), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd if r.text in (None, "", "  ", "1234 !?")] == ["und"] * 4
    assert odd[-1].rejected and all(r.rejected and r.score == 0 for r in odd if r.lang_pred == "und")
    rejected = language_id.predict(docs, model).where("rejected").count()
    assert rejected <= 0.001 * docs.count() and (model.chance >= 1).all() and not (model.chance == language_id.CHANCE).any()
    twice = language_id.predict(rows_of(spark, ["le chat", "le chat"]), model).collect()
    assert twice[0].lang_pred == twice[1].lang_pred and twice[0].score == twice[1].score
    assert language_id.fit(docs.select("text", "lang").limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(rows_of(spark, ["abc"]), None).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def test_language_id_calibrates_on_all_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(72_000)]
    texts += ["".join(rng.choice("qxzjvwkybcdf") for _ in range(10 + 3 * k)) for k in range(16)]
    labelled = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    model = language_id.fit(labelled.limit(3000).where("text LIKE '% %'"))
    language_id.calibrate(model, labelled)
    sums, sizes = language_id.Scorer(model).totals(texts)
    middle = (model.entropy[0] + model.random[0]) / 2
    above = np.sort((-sums[:, 0] / sizes - middle) * np.sqrt(sizes) / model.spread[0])[::-1]
    assert above[7] > 1 and above[6] > above[7] and model.chance[0] == pytest.approx(above[7], abs=1e-6)  # 7 of 72,016 may be rejected
    assert language_id.predict(labelled, model).where("rejected").count() == 7


@pytest.mark.parametrize("text", ["n 12 4111 1111 1111 1111", "4111 1111 1111 1111 123", "4111-1111-1111-1111-123", "12 35 4111 1111 1111 1111.", "1 2 4111111111111111 5"])
def test_card_beside_short_number(text):
    new, count = pii.pseudonymise(text, b"k" * 32)
    assert count == 1 and len(new) == len(text)
    card = re.search("4111[ -]?1111[ -]?1111[ -]?1111", text).span()
    assert new[: card[0]] == text[: card[0]] and new[card[1] :] == text[card[1] :] and new != text


def test_language_id_keeps_all_grams(spark, docs):
    few = docs.select("text", "lang").limit(60).unionByName(spark.createDataFrame([("xyzzy plugh", "rare")], "text string, lang string"))
    whole, tables = language_id.fit(few), language_id.fit(few, max_grams=100)
    texts = rows_of(spark, [*ODD, "xyzzy plugh", "qxzj vwkq zzxq jjqw xkcd qqqq" * 20, *[r.text for r in few.limit(5).collect()]])
    a, b = (language_id.predict(texts, m).orderBy("doc_id").collect() for m in (whole, tables))
    assert "rare" in {r.lang_pred for r in b}
    assert [(r.text, r.lang_pred, r.rejected) for r in a] == [(r.text, r.lang_pred, r.rejected) for r in b]
    assert all(x.score == pytest.approx(y.score, abs=1e-4) and x.cross_entropy == pytest.approx(y.cross_entropy, rel=1e-4) for x, y in zip(a, b, strict=True) if x.cross_entropy is not None)
    limits = tables.limits
    assert np.allclose(whole.entropy, limits.entropy, rtol=1e-4) and np.allclose(whole.spread, limits.spread, rtol=1e-3) and np.allclose(whole.random, limits.random, rtol=1e-4)


def plain_kneser_ney(counts, letters, text):
    """Log-probability of a text under interpolated Kneser-Ney of order 4, straight from the definition, by dictionaries."""
    tables = [counts]
    for _ in range(3):
        shorter: dict = {}
        for gram in tables[0]:
            shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
        tables.insert(0, shorter)

    def discount(table):
        n1, n2 = (sum(n == k for n in table.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    discounts = [discount(t) for t in tables]

    def p(gram):
        if not gram:
            return 1 / letters
        table, d = tables[len(gram) - 1], discounts[len(gram) - 1]
        seen = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not seen:
            return p(gram[1:])
        return max(table.get(gram, 0) - d, 0) / sum(seen) + d * len(seen) / sum(seen) * p(gram[1:])

    grams = [tuple((int(g) >> s) & 0xFFFF for s in (48, 32, 16, 0)) for g in language_id.grams([text])[0]]
    return sum(np.log(p(g)) for g in grams)


def test_kneser_ney_against_plain_version():
    train = {"x": "the then there that abba baab cab theatre", "y": "zum zam zimt und hund rund bunt abba"}
    by_lang = {lang: np.unique(language_id.grams([t])[0], return_counts=True) for lang, t in train.items()}
    model = language_id.fit_counts(["x", "y"], by_lang)
    every = {c for keys, _ in by_lang.values() for c in (keys & np.uint64(0xFFFF)).tolist()}
    texts = ["the hund", "abba zzz", "qux", "rund there zimt"]
    sums, _ = language_id.Scorer(model).totals(texts)
    for j, lang in enumerate(["x", "y"]):
        keys, counts = by_lang[lang]
        grams = {tuple((int(g) >> s) & 0xFFFF for s in (48, 32, 16, 0)): int(n) for g, n in zip(keys, counts, strict=True)}
        for i, text in enumerate(texts):
            assert sums[i, j] == pytest.approx(plain_kneser_ney(grams, len(every) + 1, text), rel=1e-4)


def test_random_letters_are_all_runs_of_four():
    train = {"x": "the then there that abba baab cab theatre", "y": "zum zam zimt und hund rund bunt abba"}
    model = language_id.fit_counts(["x", "y"], {k: np.unique(language_id.grams([t])[0], return_counts=True) for k, t in train.items()})
    letters = np.unique(np.concatenate([language_id.grams([t])[0] for t in train.values()]) & np.uint64(0xFFFF))
    runs = letters
    for _ in range(3):
        runs = (runs[:, None] << np.uint64(16) | letters).ravel()
    assert np.allclose(model.random, -model.score(runs).astype(float).mean(axis=0), rtol=1e-5)


def test_kneser_ney_sums_to_one():
    keys, counts = np.unique(language_id.grams(["the then there that abba baab cab"])[0], return_counts=True)
    model = language_id.fit_counts(["x"], {"x": (keys, counts)})
    letters = np.unique(keys & np.uint64(0xFFFF))
    for context in np.unique(keys >> np.uint64(16)):
        total = np.exp(model.score((context << np.uint64(16)) | letters).astype(float)).sum() + np.exp(model.score(np.array([(context << np.uint64(16)) | np.uint64(0xD7FF)]))).item()
        assert abs(total - 1) < 1e-5


# 6: reply trees


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "<|turn|> \\ </s>", 0.0), ("t", 2, 1, "assistant", "<\\|", 1.0), ("t", 3, 1, "assistant", "x", 5.0), ("t", 4, 2, "a\nb\\n", "[INST]", 9.0), ("t", 5, 3, "user", None, 0.0), ("u", 1, 1, "user", "loop", 1.0), ("v", 8, 77, None, "orphan", None), ("v", 8, 77, None, "orphan", None)]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("depth", F.lit("clash"))
    out = reply_trees.read_back(reply_trees.format_conversations(table, branches=2)).orderBy("tree", "branch").collect()
    assert [(r.tree, r.branch, [(t.role, t.text) for t in r.turns]) for r in out] == [
        ("t", 1, [("user", "<|turn|> \\ </s>"), ("assistant", "<\\|"), ("a\nb\\n", "[INST]")]),
        ("t", 2, [("user", "<|turn|> \\ </s>"), ("assistant", "x"), ("user", "")]),
        ("v", 1, [("", "orphan")]),
    ]
    assert [r.loss_text for r in out] == ["<\\|", "x", ""]
    assert reply_trees.format_conversations(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), ("w", None, None, "user", "c", 0.0)], "tree string, node long, parent long, role string, text string, score double")
    assert [(r.tree, r.loss_text, [t.text for t in r.turns]) for r in reply_trees.read_back(reply_trees.format_conversations(nulls)).collect()] == [(None, "b", ["a", "b"])]


def test_conversations_with_null_ids_against_sql(spark, tmp_path):
    rows = [(None, 0, "user", "x<|"), (None, 1, "assistant", None), (None, None, "assistant", "\\ <s>"), (4, 0, None, "y"), (4, 1, "assistant", "z" * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = reply_trees.reply_trees_query(spark, f"file://{tmp_path}").toPandas().to_dict("records")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names = [x[0] for x in con.execute(reply_trees.ORACLE.replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,")).description]
    true = [dict(zip(names, row, strict=True)) for row in con.fetchall()]
    key = lambda r: (r["n_turns"], r["turns_sha256"])
    assert sorted(({k: None if k == "conv_id" and v != v else v for k, v in r.items()} for r in got), key=key) == sorted(true, key=key)


def test_long_chain(spark):
    chain = spark.range(1, 301).selectExpr("'c' AS tree", "id AS node", "CASE WHEN id > 1 THEN id - 1 END AS parent", "'user' AS role", "cast(id AS string) AS text", "1.0D AS score")
    (row,) = reply_trees.read_back(reply_trees.format_conversations(chain)).collect()
    assert [t.text for t in row.turns] == [str(i) for i in range(1, 301)]


def test_reply_trees_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def noting(write):
        return lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *rest)

    monkeypatch.setattr(reply_trees, "written", noting(reply_trees.written))
    monkeypatch.setattr(reply_trees, "kept_counting", noting(reply_trees.kept_counting))
    chain = spark.range(1, 41).selectExpr("'c' AS tree", "id AS node", "CASE WHEN id > 1 THEN id - 1 END AS parent", "'user' AS role", "cast(id AS string) AS text", "1.0D AS score")
    out = reply_trees.format_conversations(reply_trees.written(chain, "chain"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 1 and sum("SortMergeJoin" in x for x in plans) >= 14
    assert not [x for x in plans if "Broadcast" in x]


def test_reply_trees_write_few_tables_and_no_markers(spark, monkeypatch):
    folders = []

    def noting(write):
        def wrapped(df, *rest):
            out = write(df, *rest)
            table = out[0] if isinstance(out, tuple) else out
            folders.append(getattr(table, "_written_at", None) or table._kept_at)
            return out

        return wrapped

    monkeypatch.setattr(reply_trees, "written", noting(reply_trees.written))
    monkeypatch.setattr(reply_trees, "kept_counting", noting(reply_trees.kept_counting))
    chain = spark.range(1, 41).selectExpr("'c' AS tree", "id AS node", "CASE WHEN id > 1 THEN id - 1 END AS parent", "'user' AS role", "cast(id AS string) AS text", "1.0D AS score")
    (row,) = reply_trees.read_back(reply_trees.format_conversations(chain)).collect()
    assert [t.text for t in row.turns] == [str(i) for i in range(1, 41)]
    # Seven rounds, one table of messages at their root and one for each hop but the last.
    assert len(folders) == 13
    files = [x.name for folder in folders for x in pathlib.Path(folder.removeprefix("file://")).iterdir()]
    assert any(x.endswith(".parquet") for x in files) and not [x for x in files if "_SUCCESS" in x]


def test_best_branches_against_plain_walks(spark):
    rng = random.Random(5)
    # Parents are drawn from the last few messages, so paths are long; node 0 of each tree is its root, nodes 90 and 91 are a cycle.
    parents = {(tree, n): rng.randrange(max(0, n - 4), n) if n else None for tree in range(6) for n in range(60)}
    parents |= {(tree, n): 181 - n for tree in range(6) for n in (90, 91)}
    scores = {key: float(rng.randrange(4)) for key in parents}
    table = spark.createDataFrame([(t, n, p, "user", f"{n}", scores[t, n]) for (t, n), p in parents.items()], "tree int, node int, parent long, role string, text string, score double")
    got = {(r.tree, r.branch): (r.leaf, [int(t.text) for t in r.turns]) for r in reply_trees.read_back(reply_trees.format_conversations(table, branches=3)).collect()}
    true = {}
    for tree in range(6):
        ways = []
        for leaf in set(range(60)) - {p for (t, _), p in parents.items() if t == tree}:
            way = [leaf]
            while parents[tree, way[-1]] is not None:
                way.append(parents[tree, way[-1]])
            ways.append((-sum(scores[tree, n] for n in way), leaf, way[::-1]))
        true |= {(tree, k): (leaf, way) for k, (_, leaf, way) in enumerate(sorted(ways)[:3], 1)}
    assert got == true


# 7: near-duplicates


def folded_words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def edit_distance(a, b):
    """The plain table, row by row."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        step = np.minimum(row[1:] + 1, row[:-1] + np.array([y != x for y in b], int)) if len(b) else row[1:]
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def brute_classes(rows, similarity=0.8):
    """Classes by all pairs of texts that share a sketch and whose words are at the similarity by edit distance."""
    words = [folded_words(t) for _, t in rows]
    found = []
    for w in words:
        hashes = near_dedup._hashed(pa.array([" ".join(w)], pa.string()))[3]
        found.append(near_dedup.sketches(near_dedup.kmers(hashes)) if len(w) else None)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if not words[i] or not words[j]:
                continue
            longer = max(len(words[i]), len(words[j]))
            if words[i] == words[j] or ((found[i] == found[j]).any() and edit_distance(words[i], words[j]) <= (1 - similarity) * longer + 1e-9):
                parent[find(i)] = find(j)
    classes: dict = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return {d: min((x for x in v if x is not None), default=None) for v in classes.values() for d in v}


@pytest.mark.parametrize("edits", [0, 1, 3, 8, 14, 30])
def test_alignment_against_plain_table(edits):
    random.seed(edits)
    for _ in range(30):
        a = [random.randrange(500) for _ in range(random.randrange(5, 90))]
        b = list(a)
        for _ in range(edits):
            at = random.randrange(len(b) + 1)
            b[at : at + random.choice([0, 1, 1])] = random.choice([[], [random.randrange(500)]])
        if not b:
            continue
        x, y = (near_dedup.Parsed(np.array(w, np.uint64), 5) for w in (a, b))
        true = edit_distance(a, b)
        assert near_dedup._distance(a, b) == true
        score, longer = near_dedup.aligned(x, y, 0.8), max(len(a), len(b))
        assert score <= 1 - true / longer + 1e-12 and (score == 0 or score >= 0.8 - 1e-9)
        if edits == 1 and len(a) > 20:
            assert score == pytest.approx(1 - true / longer)


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(120)]
    for k in range(60):  # a large group of near copies
        copy = list(base)
        for _ in range(random.randrange(5)):
            copy[random.randrange(len(copy))] = random.choice(words)
        rows.append((10_000 + k, " ".join(copy)))
    passage = [random.choice(words) for _ in range(50)]
    # A passage that takes up from three to nine tenths of its texts: some are near each other and some aren't.
    rows += [(20_000 + k, " ".join(passage + [random.choice(words) for _ in range(random.randrange(5, 20))])) for k in range(60)]
    rows += [(30_000, None), (30_001, ""), (30_002, "one two"), (30_003, "One, two!"), (30_004, "one two three"), (None, rows[0][1]), (None, "null id " * 9)]
    true = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1))
    for block_words in (100_000, 300):
        got = near_dedup.classify(df, block_words=block_words).collect()
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {d: c for d, c in true.items() if d is not None}
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == sorted(["None", str(true[rows[0][0]])])
    assert len({true[10_000 + k] for k in range(60)}) == 1
    kept = near_dedup.deduplicated(spark.createDataFrame([*rows, rows[0], (30_001, "")], "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*{c for d, c in true.items() if d is not None}, 30_001, None]))
    assert near_dedup.classify(empty(spark)).count() == 0


def test_near_duplicates_move_a_group_once(spark, monkeypatch):
    def counted(k, similarity):
        return lambda table: pa.table({"a": table.column("node"), "b": table.column("node")})

    # All of 40 unlike texts share six buckets: a member is moved once a part, not once a part and bucket.
    texts = spark.createDataFrame([(i, f"w{i} " * 50) for i in range(40)], "node long, text string")
    nodes = texts.select("node", F.array(*[F.lit(t).cast("long") for t in range(6)]).alias("sketches"))
    met = texts.select("node", F.lit(50).cast("long").alias("size"), F.explode(F.array(*map(F.lit, range(6)))).alias("t"))
    met = met.withColumn("bucket", F.col("t").cast("long")).withColumn("n", F.lit(40)).withColumn("leader", F.lit(0).cast("long"))
    labels = spark.createDataFrame([], "node long, label long")
    assert near_dedup._class_links(met, labels, nodes, texts, 5, 0.8, 1000).count() == 0
    moved = []
    monkeypatch.setattr(near_dedup, "_block", counted)
    monkeypatch.setattr(type(texts), "distinct", lambda df: moved.append(df) or df)
    near_dedup._class_links(met, labels, nodes, texts, 5, 0.8, 1000)
    assert moved[-1].count() == 40 * 3


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {n: n for pair in links for n in pair}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: v for n, v in label.items() if n in got} and {n for a, b in links if a != b for n in (a, b)} == set(got)


# 8: decontamination


def brute_hits(rows, items, similarity=0.8):
    fold = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    shingles = lambda w, k: {tuple(w[j : j + k]): sum(len(x.encode()) for x in w[j : j + k]) for j in range(len(w) - k + 1)}
    out = {}
    for d, t in rows:
        w = fold(t)
        for i, x in ((i, fold(t)) for i, t in items):
            if not x:
                continue
            k = min(5, len(x))
            item = shingles(x, k)
            if not item.keys() & shingles(w, k).keys():
                continue
            for s in range(max(1, len(w) - len(x) + 1)):
                own = shingles(w[s : s + len(x)], k)
                common = sum(v for g, v in own.items() if g in item)
                score = common / (sum(own.values()) + sum(item.values()) - common)
                if score >= similarity and score > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (score, s)
    return out


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()] + [(900, "one two three"), (901, "solo"), (902, ""), (903, None), (None, "an item without an id")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()][:60]
    random.seed(2)
    for k in range(150):
        w = random.choice(items[:-5])[1].split()
        for _ in range(random.randrange(3)):
            w[random.randrange(len(w))] = "qq"
        rows.append((10_000 + k, " ".join(["a b c"][: random.randrange(2)] + w)))
    rows += [(20_000, "and one two three"), (20_001, "Solo!"), (20_002, ""), (20_003, None), (20_004, "yes, an item without an id")]
    far = " ".join(f"q{i}" for i in range(9000))
    rows += [(20_005, f"{items[0][1]} {far} {items[0][1]} {far} {items[1][1]}"), (20_006, " ".join([items[2][1]] * 200))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(0))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    for block_bytes in (8 << 20, 2000):
        got = decontaminate.contamination(df, table, block_bytes=block_bytes).select("doc_id", F.explode("hits").alias("h")).collect()
        assert {(r.doc_id, r.h.item_id): (r.h.similarity, r.h.start) for r in got} == brute_hits(rows, items)
    assert decontaminate.decontaminate(df, table.limit(0)).count() == len(rows)
    assert decontaminate.contamination(empty(spark), table).count() == 0


# 9: SentencePiece


def test_sentencepiece(spark, docs):
    import sentencepiece

    name = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=name)
    texts = [*ODD, " " * 40 + "x", "▁x ▁", *[r.text for r in docs.limit(60).collect()]]
    coded = sentencepiece_fst.encode(rows_of(spark, texts, extra=True), name)
    assert {r.doc_id: r.tokens for r in coded.collect()} == {i: own.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(coded, name).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert all(r.round_trip for r in sentencepiece_fst.sentencepiece_query(spark, DIR).collect())
    assert sentencepiece_fst.encode(empty(spark), name).count() == 0


@pytest.mark.parametrize(("rule", "trim", "prefix", "unigram"), [("nmt_nfkc", True, True, True), ("nfkc", False, True, False), ("identity", True, False, True), ("nmt_nfkc_cf", True, False, False)])
def test_sentencepiece_normalisers_and_unigrams(rule, trim, prefix, unigram):
    """The machines of models with character maps, and of unigram models, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, spec = pb.ModelProto(), pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim).serialized_model_proto())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    if unigram:
        model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = sentencepiece_fst.Encoder(model.SerializeToString())
    random.seed(9)
    alphabet = "aAbe  \u3000\t\n.,;ﬁ①ｆ２é\u0301가각한 ÅÄ▁—…ß½\u200b\ufeff日本語😀"
    texts = ["", " ", "   ", "\u3000", "▁ ▁", " a  b ", *("".join(random.choice(alphabet) for _ in range(random.randrange(40))) for _ in range(400))]
    texts += ["The ﬁne  print,  of ｆｕｌｌ width texts. " * 20]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(t) for t in texts]


def test_sentencepiece_refuses_what_it_lacks():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces.add(piece="<own>", score=0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
    with pytest.raises(ValueError, match="user-defined"):
        sentencepiece_fst.Transducer(model.SerializeToString())


# 10: pseudonyms


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for size in (1, 2, 3, 7, 100, 101):
        moved = [f.permute(i, size, b"t") for i in range(size)]
        assert sorted(moved) == list(range(size)) and [f.invert(m, size, b"t") for m in moved] == list(range(size))


def test_pseudonyms(spark, docs):
    key = b"k"
    texts = ["call +1 (443) 555-5793", "4245100581169930 but 5755695738806562", "97.51.17.173 1.2.3.4.5", "und.34@mail7.example.com", "2024-02-29 31/12/1999 12/31/1999 99/99/2000", "078-05-1120 666-12-1234", "GB82 WEST 1234 5698 7654 32", "", None, "plain text"]
    counts = [1, 1, 1, 1, 3, 1, 1, 0, 0, 0]
    got = pii.apply(rows_of(spark, texts, extra=True), key).orderBy("doc_id").collect()
    assert [r.n_replaced for r in got] == counts
    for text, row, n in zip(texts, got, counts, strict=True):
        assert (row.text == text) == (n == 0)
        assert text is None or (pii.restore(row.text, key) == text and len(row.text) >= len(text) - 6)
    card = re.search(r"\d{16}", got[1].text)[0]
    assert pii.luhn_digit(card[:-1]) == int(card[-1]) and "5755695738806562" in got[1].text
    linked = pii.apply(rows_of(spark, ["a 97.51.17.173 b", "97.51.17.173"]), key).orderBy("doc_id").collect()
    assert linked[0].text == f"a {linked[1].text} b"
    for dates in (["31/12/1999", "12/31/1999", "1999-12-31"], ["05/04/2001", "2001.04.05"]):
        fields = [sorted(re.split(r"\D", pii.pseudonymise(d, key)[0])) for d in dates]
        assert fields == [fields[0]] * len(dates)
    phones = [re.sub(r"\D", "", pii.pseudonymise(p, key)[0])[-10:] for p in ("(443) 555-5793", "443.555.5793", "+1 443 555 5793")]
    assert phones == [phones[0]] * 3 and phones[0][0] > "1" and phones[0][3] > "1" and phones[0] != "4435555793"
    long = "x " * 200_000 + "078-05-1120"
    twice = pii.apply(rows_of(spark, [long, long]), key).collect()
    assert twice[0].text == twice[1].text != long and pii.restore(twice[0].text, key) == long
    assert pii.pseudonymise("_@x.com", key) == ("_@x.com", 1)
    for row in pii.apply(docs.select("doc_id", "text"), key).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        assert pii.restore(row.text, key) == row.was and (row.n_replaced > 0) == (row.text != row.was)
    assert pii.apply(empty(spark), key).count() == 0


def test_pseudonym_key_is_never_a_known_one(spark):
    text = rows_of(spark, ["97.51.17.173"])
    own = pii.apply(text).first().text
    assert own == pii.apply(text).first().text and pii.session_key(spark) == pii.session_key(spark)
    spark.conf.set(pii.KEY, "secret")
    try:
        assert pii.apply(text).first().text == pii.pseudonymise("97.51.17.173", b"secret")[0]
    finally:
        spark.conf.unset(pii.KEY)


@pytest.mark.parametrize("kind", ["date", "phone", "ssn", "card", "ip"])
def test_pseudonyms_are_one_to_one(kind):
    """Against a plain version: all values of a small range get different pseudonyms, valid ones of their own format."""
    random.seed(kind)
    make = {
        "date": lambda: f"{random.randrange(1, 29):02d}/{random.randrange(1, 13):02d}/{random.randrange(1900, 2100)}",
        "phone": lambda: f"{random.randrange(1000):03d}-{random.randrange(1000):03d}-{random.randrange(10_000):04d}",
        "ssn": lambda: f"{random.randrange(1, 666):03d}-{random.randrange(1, 100):02d}-{random.randrange(1, 10_000):04d}",
        "card": lambda: (lambda x: x + str(pii.luhn_digit(x)))(f"4{random.randrange(10**14):014d}"),
        "ip": lambda: ".".join(str(random.randrange(256)) for _ in range(4)),
    }[kind]
    values = {make() for _ in range(3000)}
    moved = {v: pii.pseudonymise(v, b"k")[0] for v in values}
    assert len(set(moved.values())) == len(values)
    assert all(len(v) == len(m) or kind == "ip" for v, m in moved.items()) and sum(v != m for v, m in moved.items()) > 0.99 * len(values)
    assert all(pii.restore(m, b"k") == v and re.sub(r"\d+", "0", v) == re.sub(r"\d+", "0", m) for v, m in moved.items())


# The pipeline and what the operators share


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as c

    current, ids = docs, []
    for name, stage in c.STAGES:
        current = c.written(stage(spark, current, DIR), name)
        ids.append({r.doc_id for r in current.select("doc_id").collect()})
        if name != c.STAGES[-1][0]:
            assert current.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids[0] == {r.doc_id for r in docs.collect()}
    assert ids[1] == set(brute_classes(rows).values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert ids[2] == ids[1] - {d for d, _ in brute_hits([r for r in rows if r[0] in ids[1]], items)}
    assert ids[2] == ids[3] == ids[4]
    key, text_of = pii.session_key(spark), dict(rows)
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in current.collect():
        assert r.tokens == own.encode(pii.pseudonymise(text_of[r.doc_id] or "", key)[0])
    assert c.run(spark, DIR).exceptAll(current).count() == 0


def test_pipeline_learns_from_all_labelled(spark):
    import corpus_pipeline as c

    tongues = {"aa": ["lomi tavu", "rasi mola", "tavu lomi rasi", "mola savu tila"], "bb": ["grenk strudz", "plokt bruntz", "krotz strudz plokt", "bruntz drenk gropt"]}
    ids = {"aa": [i for i in range(400) if zlib.crc32(b"%d" % i) % 4 != 2][:40], "bb": [i for i in range(400) if zlib.crc32(b"%d" % i) % 4 == 2][:40]}
    rows = [(i, " ".join([tongues[x][i % 4]] * 5), x, "web", 0) for x in tongues for i in ids[x]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.lang) for r in c.identify_language(spark, docs, DIR).collect()} == {(i, x) for i, _, x, *_ in rows}


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace as Has

    from lodeframe.llm.common import shared_dir

    cluster = Has(sparkContext=Has(master="spark://far:7077", applicationId="a"), conf=Has(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_likely_in_never_loses(spark):
    rows = spark.range(2000).selectExpr("id AS k", "id % 7 AS j")
    keys = rows.where("k % 10 = 0")
    found = {r.k for r in likely_in(rows, keys, "k", "j").collect()}
    assert {r.k for r in keys.collect()} <= found and len(found) < 400


def test_text_buffers_of_slices():
    column = pa.array(["ab", None, "", "cde"], pa.string()).slice(1)
    data, at = text_buffers(column)
    assert data.tobytes() == b"cde" and at.tolist() == [0, 0, 0, 3]
