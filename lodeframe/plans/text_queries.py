"""Goals, statistics, versions, INI texts, patterns, Huffman codes and LZ77 tokens."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from lodeframe.functions import codecs as C
from lodeframe.functions import goals as P
from lodeframe.functions import schemas as S
from lodeframe.functions import texts as X
from lodeframe.plans.registry import query, table


@query(
    "p10_goals",
    """SELECT p_partkey, round(100 * pow(greatest(0, abs(p_size - 25) - 2), 2) + 10 * (pow(greatest(0, 950 - p_retailprice) / 100, 2) + pow(greatest(0, p_retailprice - 1500) / 100, 2)) + 2 * pow(p_size, 2) + 1000 * pow(greatest(0, p_size - 40), 2), 6) AS score FROM part""",
)
def goals(spark, sf_dir):
    wanted = [P.Goal("p_size", "equal", "high", target=25, tolerance=2), P.Goal("p_retailprice", "range", "medium", low=950, high=1500, scale=100), P.Goal("p_size", "minimize", "low", weight=2), P.Goal("p_size", "upper", "critical", high=40)]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(P.score(wanted), 6).alias("score"))


@query("p04_p08_solved_groups", "SELECT c_nationkey, count(*) AS n, true AS found FROM customer GROUP BY c_nationkey")
def solved(spark, sf_dir):
    """The value of least squared distance to a nation's balances is their mean."""

    def model(group):
        v = group["c_acctbal"].to_numpy()
        return P.Model(lambda x: float(((v - x[0]) ** 2).mean()), [0.0])

    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    rows = P.solve_groups(customers, "c_nationkey", model, "lbfgs")
    means = customers.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))
    return rows.join(means, "c_nationkey").select("c_nationkey", "n", (F.abs(F.col("x")[0] - F.col("mean")) < 0.01).alias("found"))


@query("i01_stats", "SELECT l_returnflag, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS deviation, count(*) AS runs FROM lineitem GROUP BY l_returnflag")
def stats(spark, sf_dir):
    p = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(p).alias("least"), F.max(p).alias("most"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_pop(p), 4).alias("deviation"), F.count("*").alias("runs"))


@query("x13_ini", "SELECT event_id, section, name, value FROM (SELECT event_id, 'a' AS section, 'type' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 'b', 'user', user_id::VARCHAR FROM events)")
def ini(spark, sf_dir):
    text = F.concat(F.lit("stray=1\n; note\n[a]\n type = old\n\ttype="), "event_type", F.lit("\n# note\n[b]\nuser=0\nuser = "), F.col("user_id").cast("string"), F.lit(" \n"))
    rows = X.ini_rows(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t")
    return X.ini_rows(X.ini_text(rows, "event_id"), "event_id", "text")


@query("x14_versions", "SELECT p_partkey, p_partkey // 100 AS major, p_partkey % 100 AS minor, p_size::BIGINT AS patch, 7::BIGINT AS build, printf('%d.%02d.%03d.007', p_partkey // 100, p_partkey % 100, p_size) AS text FROM part")
def versions(spark, sf_dir):
    text = F.format_string("%d.%02d.%03d.007", F.floor(F.col("p_partkey") / 100), F.col("p_partkey") % 100, "p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", X.parse_version(text).alias("v"))
    return rows.select("p_partkey", "v.major", "v.minor", "v.patch", "v.build", X.format_version(F.col("v")).alias("text"))


@query("x15_patterns", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN p_size BETWEEN 2 AND 9 THEN 'few' WHEN p_size < 40 THEN 'many' ELSE 'most' END AS kind, ((p_size <= 10)::INT + (p_size >= 5 AND p_size < 20)::INT * 2 + (p_size % 2 = 0)::INT * 4)::BIGINT AS folded FROM part")
def patterns(spark, sf_dir):
    v = F.col("p_size")
    kind = X.first_match(v, [(lambda x: x == 1, lambda x: F.lit("one")), (X.within(2, 9), lambda x: F.lit("few")), (lambda x: x < 40, lambda x: F.lit("many"))], F.lit("most"))
    every = X.all_matches(v, [(lambda x: x <= 10, lambda x: F.lit(1)), (X.within(5, 20, "left"), lambda x: F.lit(2)), (lambda x: x % 2 == 0, lambda x: F.lit(4))])
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.aggregate(every, F.lit(0), lambda a, x: a + x).cast("long").alias("folded"))


_COUNTS = "SELECT source, c AS symbol, count(*) AS freq FROM (SELECT source, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2"


@query("c20_symbol_counts", _COUNTS)
def symbol_counts(spark, sf_dir):
    return X.symbol_counts(table(spark, sf_dir, "documents"), "source", "text")


@query("c21_c22_c24_huffman", f"WITH c AS ({_COUNTS}) SELECT source, round(log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq), 6) AS entropy, count(*) AS leaves, true AS optimal_range, 1.0::DOUBLE AS kraft_sum FROM c GROUP BY source")
def huffman(spark, sf_dir):
    codes = X.huffman_table(X.symbol_counts(table(spark, sf_dir, "documents"), "source", "text"), "source")
    rows = X.code_statistics(codes, "source")
    good = (F.col("entropy") <= F.col("average_length") + 1e-9) & (F.col("average_length") < F.col("entropy") + 1)
    return rows.select("source", F.round("entropy", 6).alias("entropy"), "leaves", good.alias("optimal_range"), F.round("kraft_sum", 9).alias("kraft_sum"))


@query("c13_lz77", "SELECT item_id, sha256(text) AS sha256, true AS shorter FROM benchmark")
def lz77(spark, sf_dir):
    """The bytes that a text's tokens stand for, and that matches spare some of them."""
    tokens = X.lz77(table(spark, sf_dir, "benchmark").select("item_id", C.utf8("text").alias("d")), "item_id", "d", lazy=True)

    def decoded(group):
        rows = group.sort_values("pos")[["distance", "length", "literal"]].itertuples(index=False, name=None)
        data = X.lz77_bytes(list(rows))
        return pd.DataFrame({"item_id": group["item_id"].iloc[:1], "sha256": [hashlib.sha256(data).hexdigest()], "shorter": [len(group) < len(data)]})

    return tokens.groupBy("item_id").applyInPandas(decoded, "item_id long, sha256 string, shorter boolean")


@query(
    "c22_c23_huffman_round_trip",
    """WITH c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY c)
SELECT item_id, text AS decoded, true AS same_tree, length(text) <= 9 * length(text) AND (SELECT count(*) FROM c) > 1 AS within_limit FROM benchmark""",
)
def huffman_round_trip(spark, sf_dir):
    """Texts through the code of all of them, limited to nine bits; the code goes through its tree's text. The table of symbols is small."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    counts = X.symbol_counts(items.withColumn("all", F.lit(0)), "all", "text")
    codes = {r.symbol: r.code for r in X.huffman_table(counts, "all", 9).collect()}
    tree = X.tree_codes(X.tree_text(codes))

    @F.pandas_udf("decoded string, same_tree boolean, within_limit boolean")
    def trip(texts: pd.Series) -> pd.DataFrame:
        bits = [X.encode_symbols(t, codes) for t in texts]
        return pd.DataFrame({"decoded": [X.decode_symbols(b, tree) for b in bits], "same_tree": tree == codes, "within_limit": [len(b) <= 9 * len(t) for b, t in zip(bits, texts, strict=True)]})

    return items.select("item_id", trip("text").alias("t")).select("item_id", "t.*")


@query(
    "p01_p06_solvers",
    """WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, round(mean, 1) AS lbfgs, round(mean, 1) AS nelder_mead, round(mean, 1) AS cma_es, round(least(mean, 4000), 1) AS bounded, round(least(mean, 4000), 1) AS constrained, round(least(mean, 4000), 1) AS multiplied FROM m""",
)
def solvers(spark, sf_dir):
    """The value of least squared distance to a nation's balances by each algorithm, free, in bounds, and under a constraint."""

    def model(high=None, limit=None):
        def build(group):
            v = group["c_acctbal"].to_numpy()
            rules = [] if limit is None else [(lambda x: float(x[0]), "<=", limit)]
            return P.Model(lambda x: float(((v - x[0]) ** 2).mean()), [0.0], high=None if high is None else [high], constraints=rules)

        return build

    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    runs = {
        "lbfgs": (model(), "lbfgs", "penalty", 1),
        "nelder_mead": (model(), "nelder_mead", "penalty", 1),
        "cma_es": (model(), "cma_es", "penalty", 1),
        "bounded": (model(high=4000.0), "nelder_mead", "penalty", 1),
        "constrained": (model(limit=4000.0), "nelder_mead", "penalty", 1),
        "multiplied": (model(limit=4000.0), "nelder_mead", "lagrangian", 1),
    }
    out = customers.select("c_nationkey").distinct()
    for name, (build, algorithm, method, digits) in runs.items():
        found = P.solve_groups(customers, "c_nationkey", build, algorithm, method)
        out = out.join(found.select("c_nationkey", F.round(F.col("x")[0], digits).alias(name)), "c_nationkey")
    return out


@query(
    "p03_objective_terms",
    """WITH r AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 100 AS c FROM part),
v AS (SELECT *, greatest(0, s - 30) AS a, abs(c - 12) AS b, greatest(0, 5 - s) AS d FROM r)
SELECT p_partkey, round(c * c + 10 * (a * a + b * b + d * d), 6) AS squared, round(c * c + 10 * (a + b + d), 6) AS absolute,
  round(c * c + (pow(greatest(0, 1 + 4 * (s - 30)), 2) - 1) / 8 + 2 * (c - 12) + 2 * pow(c - 12, 2) + (pow(greatest(0, 3 + 4 * (5 - s)), 2) - 9) / 8, 6) AS lagrangian,
  round(greatest(0, 1 + 4 * (s - 30)), 6) AS next_most, round(2 + 4 * (c - 12), 6) AS next_equal, round(greatest(0, 3 + 4 * (5 - s)), 6) AS next_least,
  CASE WHEN a > 0 THEN 'most,' ELSE '' END || CASE WHEN b > 0 THEN 'equal,' ELSE '' END || CASE WHEN d > 0 THEN 'least,' ELSE '' END AS broken FROM v""",
)
def objective_terms(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    rules = [P.Rule("most", size, "<=", 30), P.Rule("equal", price, "=", 12), P.Rule("least", size, ">=", 5)]
    held = [1.0, 2.0, 3.0]
    after = P.next_multipliers(rules, held, 4.0)
    terms = {"squared": P.penalty_terms(rules, 10.0), "absolute": P.penalty_terms(rules, 10.0, squared=False), "lagrangian": P.lagrangian_terms(rules, held, 4.0)}
    broken = F.filter(terms["squared"], lambda t: t["violation"] > 0)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *(F.round(P.with_terms(price * price, t), 6).alias(name) for name, t in terms.items()),
        *(F.round(m, 6).alias(f"next_{r.name}") for m, r in zip(after, rules, strict=True)),
        F.array_join(F.transform(broken, lambda t: F.concat(t["name"], F.lit(","))), "").alias("broken"),
    )


@query("p09_p11_goal_solvers", "SELECT DISTINCT p_size, p_size::DOUBLE AS compiled, p_size::DOUBLE AS by_priority FROM part")
def goal_solvers(spark, sf_dir):
    """A firm goal at the size, against a wish for less: as a constraint, and level by level."""

    def goals_of(size):
        return [P.Goal("x", "equal", "high", target=size), P.Goal("x", "minimize", "low")], {"x": lambda v: float(v[0])}

    def build(group):
        wanted, metrics = goals_of(float(group["p_size"].iloc[0]))
        return P.compile_goals(wanted, metrics, [1.0], hard="high")

    def levels(group):
        size = float(group["p_size"].iloc[0])
        return pd.DataFrame({"p_size": group["p_size"].iloc[:1], "by_priority": [round(float(P.solve_by_priority(*goals_of(size), [1.0])[0]), 1)]})

    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    compiled = P.solve_groups(sizes, "p_size", build).select("p_size", F.round(F.col("x")[0], 1).alias("compiled"))
    return compiled.join(sizes.groupBy("p_size").applyInPandas(levels, "p_size int, by_priority double"), "p_size")


_REGIONS = {0: "AFRICA", 1: "AMERICA", 2: "ASIA", 3: "EUROPE", 4: "MIDDLE EAST"}


@query("i04_enum_names", "SELECT n_name, r_name AS name, n_regionkey::BIGINT AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def enum_names(spark, sf_dir):
    names = S.enum_name("n_regionkey", _REGIONS)
    return table(spark, sf_dir, "nation").select("n_name", names.alias("name"), S.enum_value(names, _REGIONS).alias("value"))


@query(
    "i04_describe",
    "SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS kind FROM (DESCRIBE customer)",
)
def described(spark, sf_dir):
    return S.describe(spark, table(spark, sf_dir, "customer")).select("position", "name", "kind")
