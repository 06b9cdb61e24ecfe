"""Tower numbers over prices: on plain numbers they are doubles."""

from pyspark.sql import functions as F

from lodeframe.functions import tower as N
from lodeframe.plans.registry import query, table


@query(
    "n01_n08_tower_arithmetic",
    """SELECT p_partkey, round(p_retailprice + p_size, 6) AS added, round(p_retailprice * p_size, 6) AS multiplied, round(p_retailprice / p_size, 6) AS divided, round(pow(p_size, 3), 6) AS cubed, round(sqrt(p_retailprice), 6) AS root, round(log10(p_retailprice), 6) AS log, round(gamma((p_size % 9 + 1)::DOUBLE), 3) AS gamma, round(p_retailprice - p_size, 6) AS parsed FROM part""",
)
def arithmetic(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", N.towers("p_retailprice").alias("a"), N.towers("p_size").alias("b"), N.towers(F.lit(3.0)).alias("c"), N.towers(F.col("p_size") % 9 + 1).alias("g"), N.parsed(F.col("p_retailprice").cast("string")).alias("t"))
    out = {"added": N.binary("add", "a", "b"), "multiplied": N.binary("multiply", "a", "b"), "divided": N.binary("divide", "a", "b"), "cubed": N.binary("power", "b", "c"), "root": N.unary("sqrt", "a"), "log": N.unary("log10", "a"), "gamma": N.unary("gamma", "g"), "parsed": N.binary("subtract", "t", "b")}
    rows = rows.select("p_partkey", *(v.alias(k) for k, v in out.items()))
    return rows.select("p_partkey", *(F.round(N.numbers(k), 3 if k == "gamma" else 6).alias(k) for k in out))


@query("n05_n13_tower_order", "SELECT c_nationkey, max(c_acctbal) AS most, min(c_acctbal) AS least, max(floor(c_acctbal)) AS most_whole FROM customer GROUP BY c_nationkey")
def order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", N.towers("c_acctbal").alias("t"))
    rows = rows.select("c_nationkey", "t", N.unary("floor", "t").alias("f"))
    best = rows.groupBy("c_nationkey").agg(F.max_by("t", N.sort_key("t")).alias("most"), F.min_by("t", N.sort_key("t")).alias("least"), F.max_by("f", N.sort_key("f")).alias("most_whole"))
    return best.select("c_nationkey", *(N.numbers(c).alias(c) for c in ("most", "least", "most_whole")))


@query(
    "n15_series",
    """SELECT p_partkey, round(p_retailprice * (1 - pow(1.15::DOUBLE, p_size)) / (1 - 1.15::DOUBLE), 6) AS geometric, round(p_size / 2.0::DOUBLE * (2 * p_retailprice + (p_size - 1) * 7), 6) AS arithmetic, floor((-(p_retailprice - 3.5) + sqrt(pow(p_retailprice - 3.5, 2) + 14 * 100000)) / 7)::BIGINT AS affordable FROM part""",
)
def series(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(N.geometric_sum("p_size", "p_retailprice", 1.15), 6).alias("geometric"), F.round(N.arithmetic_sum("p_size", "p_retailprice", 7.0), 6).alias("arithmetic"), N.arithmetic_afford(100000.0, "p_retailprice", 7.0).alias("affordable"))


_INSIDE = ("asin", "acos", "atanh")


@query(
    "n12_trigonometry",
    """SELECT c_custkey, round(sin(v), 9) + 0.0 AS sin, round(cos(v), 9) + 0.0 AS cos, round(atan(v), 9) + 0.0 AS atan, round(asin(v / 20), 9) + 0.0 AS asin, round(acos(v / 20), 9) + 0.0 AS acos, round((exp(v) - exp(-v)) / 2, 4) + 0.0 AS sinh, round((exp(v) + exp(-v)) / 2, 4) AS cosh, round(1 - 2 / (exp(2 * v) + 1), 9) + 0.0 AS tanh, round(ln((1 + v / 20) / (1 - v / 20)) / 2, 9) + 0.0 AS atanh, round(ln(1 + abs(v) + sqrt(pow(1 + abs(v), 2) - 1)), 7) + 0.0 AS acosh, round(sign(v) * ln(abs(v) + sqrt(v * v + 1)), 9) + 0.0 AS asinh, 0.0::DOUBLE AS far FROM (SELECT c_custkey, c_acctbal / 1000 AS v FROM customer)""",
)
def trigonometry(spark, sf_dir):
    v = F.col("c_acctbal") / 1000
    rows = table(spark, sf_dir, "customer").select("c_custkey", N.towers(v).alias("v"), N.towers(v / 20).alias("w"), N.towers(1 + F.abs(v)).alias("u"), N.unary("pow10", N.towers(F.abs(v) + 30)).alias("far"))
    digits = {"sin": 9, "cos": 9, "atan": 9, "asin": 9, "acos": 9, "sinh": 4, "cosh": 4, "tanh": 9, "atanh": 9, "acosh": 7, "asinh": 9}
    out = {name: N.unary(name, "w" if name in _INSIDE else "u" if name == "acosh" else "v") for name in digits}
    rows = rows.select("c_custkey", *(x.alias(name) for name, x in out.items()), N.unary("sin", "far").alias("far"))
    return rows.select("c_custkey", *((F.round(N.numbers(name), d) + 0.0).alias(name) for name, d in digits.items()), N.numbers("far").alias("far"))


@query(
    "n09_n11_towers",
    """SELECT p_partkey, [1, 2, 4, 16][p_size % 4 + 1]::DOUBLE AS tetrated, (p_size % 9 + 2)::DOUBLE AS super_root, round(p_size / 10, 6) AS lambertw, (p_size % 3 + 1)::DOUBLE AS unlogged FROM part""",
)
def high_towers(spark, sf_dir):
    n, x = F.col("p_size") % 9 + 2, F.col("p_size") / 10
    rows = table(spark, sf_dir, "part").select("p_partkey", N.towers(F.lit(2.0)).alias("two"), N.towers(F.col("p_size") % 4).alias("h"), N.towers(F.pow(n, n)).alias("own"), N.towers(x * F.exp(x)).alias("w"), N.towers(F.col("p_size") % 3 + 1).alias("k"))
    rows = rows.withColumn("up", N.binary("iterated_exp", "k", "two"))
    rows = rows.select("p_partkey", N.binary("tetrate", "two", "h").alias("tetrated"), N.unary("super_root", "own").alias("super_root"), N.unary("lambertw", "w").alias("lambertw"), N.binary("iterated_log", "up", "two").alias("unlogged"))
    return rows.select("p_partkey", *(F.round(N.numbers(c), 6).alias(c) for c in ("tetrated", "super_root", "lambertw", "unlogged")))


@query("n14_formatted", "SELECT p_partkey, p_size::VARCHAR AS plain, '-' || p_size AS negative, 'e' || (p_size + 20) || '.0' AS large, 'ee' || (p_size + 20) || '.0' AS larger FROM part")
def formatted(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", N.towers("p_size").alias("t"), N.towers(F.col("p_size") + 20).alias("u"))
    rows = rows.withColumn("v", N.unary("pow10", "u"))
    out = {"plain": F.col("t"), "negative": N.unary("negate", "t"), "large": F.col("v"), "larger": N.unary("pow10", "v")}
    rows = rows.select("p_partkey", *(x.alias(name) for name, x in out.items()))
    return rows.select("p_partkey", *(N.formatted(F.col(name)).alias(name) for name in out))


@query(
    "n15_affordable",
    """SELECT p_partkey, floor(ln(100000 / (p_retailprice * pow(1.15::DOUBLE, 2)) * (1.15::DOUBLE - 1) + 1) / ln(1.15::DOUBLE))::BIGINT AS geometric, round(p_retailprice / 50 + p_retailprice / p_size, 6) AS efficiency FROM part""",
)
def affordable(spark, sf_dir):
    rate, gain = F.lit(50.0), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", N.geometric_afford(100000.0, "p_retailprice", 1.15, 2.0).alias("geometric"), F.round(N.purchase_efficiency("p_retailprice", rate, gain), 6).alias("efficiency"))
