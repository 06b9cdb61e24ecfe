"""Lexers, parsers, solvers, compression tokens, tower numbers and streaming state."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import goals as P
from lodeframe.functions import syntax as L
from lodeframe.functions import texts as X
from lodeframe.functions import tower as N
from lodeframe.plans import library
from lodeframe.plans.extensions import Extension, Extensions
from lodeframe.sources.ini import read_ini, write_ini
from lodeframe.streaming import stateful as S


def test_lexer_priority_position_and_errors():
    rules = L.Lexer([("if", 1), ("[a-z]+", 2), ("[0-9]+", 3), ("[ \\n]+", 4), ("\"[^\"]*\"", 5)])
    assert rules.resolve("if iffy 12\n\"a b\"") == [("if", 1, 1, 1, 0), (" ", 4, 1, 3, 0), ("iffy", 2, 1, 4, 0), (" ", 4, 1, 8, 0), ("12", 3, 1, 9, 0), ("\n", 4, 1, 11, 0), ('"a b"', 5, 2, 1, 0)]
    assert rules.resolve("a?b", error=9) == [("a", 2, 1, 1, 0), ("?", 9, 1, 2, 1), ("b", 2, 1, 3, 0)]
    assert rules.resolve("a?b")[-1] == ("?", -1, 1, 2, 2)
    assert [w[0] for w in L.Lexer([("(ab|c)+d?", 1)]).resolve("abcabdc")] == ["abcabd", "c"]
    for bad in ("(a", "a)", "a\\"):
        with pytest.raises(ValueError):
            L.Lexer([(bad, 1)])


def test_parser():
    grammar = L.Parser([("e", ["e", "+", "t"]), ("e", ["t"]), ("t", ["t", "*", "f"]), ("t", ["f"]), ("f", ["(", "e", ")"]), ("f", ["n"])])
    assert grammar.validate(list("n+n*(n+n)")) and not grammar.validate(list("n+")) and grammar.to_rows()
    assert grammar.run(["n", "?", "+", "n"], lambda kind, _: "skip")[-1][0] == "accept"
    assert grammar.follow["t"] == {"+", "*", ")", "$"}
    with pytest.raises(ValueError):
        L.Parser([("s", ["s", "s"]), ("s", ["a"])])


def test_solvers():
    rosenbrock = P.Model(lambda x: float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), [-1.2, 1.0])
    for name in ("nelder_mead", "lbfgs"):
        assert np.allclose(P.solve(rosenbrock, name)[0], [1, 1], atol=1e-3)
    sphere = P.Model(lambda x: float(((x - 3) ** 2).sum()), [0.0, 0.0])
    assert np.allclose(P.solve(sphere, "cma_es")[0], [3, 3], atol=1e-2)
    bound = P.Model(lambda x: float(x[0] + x[1]), [2.0, 2.0], constraints=[(lambda x: float(x[0] * x[1]), ">=", 1.0)], low=[0.1, 0.1], high=[9.0, 9.0])
    for method in ("penalty", "lagrangian"):
        x, value, broken = P.solve(bound, "nelder_mead", method)
        assert abs(value - 2) < 0.02 and broken < 0.01
    goals = [P.Goal("a", "equal", "compulsory", target=2.0), P.Goal("a", "minimize", "low"), P.Goal("b", "lower", "high", low=5.0)]
    metrics = {"a": lambda x: float(x[0]), "b": lambda x: float(x[1])}
    x = P.solve_by_priority(goals, metrics, [0.0, 0.0])
    assert abs(x[0] - 2) < 0.05 and x[1] > 4.9
    assert len(P.compile_goals(goals, metrics, [0.0, 0.0], "high").constraints) == 3


def test_huffman_and_lz77():
    freqs = {"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5}
    depths = X.huffman_depths(list(freqs.values()))
    assert sum(f * d for f, d in zip(freqs.values(), depths, strict=True)) == 224
    assert sum(f * d for f, d in zip(freqs.values(), X.limited_depths(list(freqs.values()), 4), strict=True)) == 224
    assert max(X.limited_depths([1, 2, 4, 8, 16, 32], 3)) == 3 and X.huffman_depths([7]) == [1]
    with pytest.raises(ValueError):
        X.limited_depths([1] * 5, 2)
    codes = X.canonical_codes(dict(zip(freqs, depths, strict=True)))
    assert X.decode_symbols(X.encode_symbols("fadedcab", codes), codes) == "fadedcab"
    assert X.tree_codes(X.tree_text(codes)) == codes and X.tree_codes(X.tree_text({"a": "0"})) == {"a": "0"}
    assert X.sibling_property({k: (f, d) for (k, f), d in zip(freqs.items(), depths, strict=True)})
    data = b"abracadabra abracadabra " * 20 + bytes(range(50))
    for lazy in (False, True):
        tokens = X.lz77_tokens(data, 64, lazy)
        assert X.lz77_bytes(tokens) == data and len(tokens) < 150


def test_tower_numbers():
    assert N.text_of(N.parse("10^^4")) == "ee10000000000.0" and N.parse("1e400") == (1, 1.0, 400.0)
    assert N.compare(N.parse("ee20"), N.parse("1e300")) == 1 and N.compare(N.NAN, N.NAN) is None
    assert N.number(N.multiply(N.parse("1e200"), N.parse("1e-190"))) == pytest.approx(1e10)
    assert N.number(N.add(N.parse("1e20"), N.of(1))) == pytest.approx(1e20)
    assert N.number(N.lambertw(N.of(1.0))) == pytest.approx(0.567143290409784)
    assert N.number(N.super_root(N.of(27.0))) == pytest.approx(3) and N.slog(N.parse("10^^4")) == pytest.approx(4)
    assert N.number(N.power(N.of(-2.0), N.of(3.0))) == pytest.approx(-8) and math.isnan(N.number(N.log10(N.of(-1.0))))
    assert N.rounded(N.of(-2.5), N.half_away)[0:3] == (-1, 0.0, 3.0)
    for bad in ("", "abc", "1e"):
        with pytest.raises(ValueError):
            N.parse(bad)


def test_ini_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ini").write_text("x=0\n[s]\n ; no\nk = v\nk=w\n[t]\nk= \n")
    rows = read_ini(spark, f"file://{tmp_path}/in")
    assert sorted((r.section, r.name, r.value) for r in rows.collect()) == [("s", "k", "w"), ("t", "k", "")]
    write_ini(rows, f"file://{tmp_path}/out", "file")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ["[s]", "k=w", "[t]", "k="]


def test_streaming_state(spark, tmp_path):
    rows = [(i % 2, i, bytes([65 + i % 26]) * 900) for i in range(200)]
    spark.createDataFrame(rows, "k long, n long, d binary").repartition(3).write.parquet(f"file://{tmp_path}/s")

    def run(f, mode, name):
        stream = spark.readStream.schema("k long, n long, d binary").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/s")
        query = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/c-{name}").start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    sizes = {}
    for r in run(lambda s: S.running_checksum(s, "k", "n", "d"), "update", "sums"):
        sizes[r.k] = max(sizes.get(r.k, 0), r["size"])
    assert sizes == {0: 90_000, 1: 90_000}
    blocks: dict = {}
    for r in run(lambda s: S.compressed_blocks(s, "k", "n", "d"), "append", "blocks"):
        blocks.setdefault(r.k, []).append((r.number, bytes(r.block)))
    for own in blocks.values():
        assert len(zlib.decompress(b"".join(b for _, b in sorted(own)) + S.FINAL_BLOCK, -15)) == 65_536
    assert len(run(lambda s: S.lru_cache(s, "k", "n", "n", 3), "append", "cache")) == 200


def test_extensions_load_behind_what_they_need():
    seen = []

    def one(name, *needs, queries=()):
        return Extension(name, {q: lambda spark, sf_dir: None for q in queries}, needs, lambda c: seen.append(f"+{name}"), lambda c: seen.append(f"-{name}"))

    known = Extensions()
    assert known.load(one("c", "b", queries=["q"]), one("a"), one("b", "a")) == ["a", "b", "c"] == known.names
    for bad, error in ((one("d", "z"), LookupError), (one("a"), ValueError), (one("e", queries=["q"]), ValueError)):
        with pytest.raises(error):
            known.load(bad)
    with pytest.raises(ValueError, match="need each other"):
        known.load(one("x", "y"), one("y", "x"))
    with pytest.raises(ValueError, match="needed by b"):
        known.unload("a")
    assert list(known.queries()) == ["q"] and seen == ["+a", "+b", "+c"]
    known.close()
    assert known.names == [] and seen[3:] == ["-c", "-b", "-a"]
    with pytest.raises(LookupError):
        known.unload("a")


def test_services_and_events():
    context = Extensions().context
    context.offer(dict, {"a": 1})
    assert context.service(dict) == {"a": 1} and context.service(list) is None
    with pytest.raises(TypeError):
        context.offer(list, 3)
    heard = []
    first = context.events.subscribe(int, lambda x: heard.append(("first", x)))
    context.events.subscribe(object, lambda x: (heard.append(("all", x)), context.events.unsubscribe(last)))
    last = context.events.subscribe(int, lambda x: heard.append(("last", x)))
    assert context.events.publish(4) == 2 and context.events.unsubscribe(first) and not context.events.unsubscribe(first)
    assert context.events.publish("s") == 1 and context.events.publish(5) == 1
    assert heard == [("first", 4), ("all", 4), ("all", "s"), ("all", 5)]


def test_rules_of_objectives():
    for bad in (lambda: P.Rule("r", None, "<", 1), lambda: P.lagrangian_terms([], [1.0])):
        with pytest.raises(ValueError):
            bad()


def test_tower_kernels_share_a_worker(spark):
    plan = library.QUERIES["n12_trigonometry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = spark.sql("SELECT * FROM VALUES (cast(NULL AS double)), (-0.5), (1e20) AS t(v)").select(N.towers("v").alias("t")).withColumn("t", F.when(F.col("t.sign").isNotNull(), F.col("t")))
    got = rows.select(N.unary("abs", "t").alias("a"), N.binary("add", "t", "t").alias("b"), N.formatted(F.col("t")).alias("c")).collect()
    assert got[0].c is None and got[0].a.sign is None and got[0].b.mag is None
    assert tuple(got[1].a) == (1, 0.0, 0.5) and tuple(got[1].b) == (-1, 0.0, 1.0) and got[2].c == "e20.0"


def test_ini_texts_within_their_row(spark):
    texts = ["k=0\r\n[a]\r\nk=1\r\n[b]\nk=2\n [a] \n k = 3=4\n\n;k=5\n[a\n=e", None, "", "[b]", "[]\nk=x"]
    rows = X.ini_rows(spark.createDataFrame(enumerate(texts), "i int, t string"), "i", "t")
    assert sorted(map(tuple, rows.collect())) == [(0, "a", "", "e"), (0, "a", "k", "3=4"), (0, "b", "k", "2"), (4, "", "k", "x")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    parts = [(1, "b", "k", "1"), (1, "a", "z", "2"), (1, "a", "k", None), (1, "a", "y", "3"), (2, "c", "k", None), (2, None, "k", "4")]
    text = X.ini_text(spark.createDataFrame(parts, "i int, section string, name string, value string"), "i")
    assert sorted(map(tuple, text.collect())) == [(1, "[a]\ny=3\nz=2\n[b]\nk=1"), (2, "[c]\n")]
    assert library.QUERIES["x13_ini"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
