"""Graphs between nations, customers and suppliers; sets; rule-constrained flags."""

from pyspark.sql import functions as F

from lodeframe.operators import graphs as G
from lodeframe.operators import sets as S
from lodeframe.plans.registry import query, table

_WEAK = "SELECT c_custkey AS src, -1 - c_nationkey AS dst FROM customer UNION ALL SELECT -1000 - s_suppkey, -1 - s_nationkey FROM supplier"
#: A directed graph with cycles and tails over the keys of nations and regions.
_ARROWS = "SELECT n_nationkey AS src, (n_nationkey * n_nationkey + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation"


def _weak(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))
    return customers.unionByName(table(spark, sf_dir, "supplier").select((-1000 - F.col("s_suppkey")).alias("src"), (-1 - F.col("s_nationkey")).cast("long").alias("dst")))


def _arrows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), "n_regionkey")
    squares = rows.select("src", ((F.col("src") * F.col("src") + 1) % 25).alias("dst"))
    return squares.unionByName(rows.select("src", F.col("n_regionkey").alias("dst"))).distinct()


_REACH = f"""WITH RECURSIVE e AS ({_ARROWS}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"""


@query(
    "g01_components",
    f"""WITH RECURSIVE e AS ({_WEAK}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, min(other) AS component FROM r GROUP BY node""",
)
def components(spark, sf_dir):
    return G.components(_weak(spark, sf_dir)).select("node", "component")


@query("g02_strong_components", _REACH + " SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strong(spark, sf_dir):
    return G.strong_components(_arrows(spark, sf_dir)).select("node", "component")


@query(
    "g03_condensed_order",
    _REACH
    + """, w AS (SELECT a, b FROM r UNION SELECT b, a FROM r), wk AS (SELECT a, min(b) AS m FROM w GROUP BY a), s AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
l AS (SELECT DISTINCT s1.component AS src, s2.component AS dst FROM e JOIN s s1 ON e.src = s1.node JOIN s s2 ON e.dst = s2.node WHERE s1.component <> s2.component),
p AS (SELECT DISTINCT component AS node, 0 AS level FROM s UNION SELECT l.dst, p.level + 1 FROM p JOIN l ON p.node = l.src)
SELECT s.node, s.component, max(p.level) AS level FROM s JOIN p ON p.node = s.component GROUP BY ALL""",
)
def condensed(spark, sf_dir):
    return G.condensed_order(_arrows(spark, sf_dir)).select("node", "component", "level")


@query("g04_closure", _REACH + " SELECT a AS node, count(DISTINCT b % 10)::BIGINT AS n_values, min(b % 10) AS least FROM r GROUP BY a")
def closure(spark, sf_dir):
    edges = _arrows(spark, sf_dir)
    out = G.closure_union(edges, G.nodes_of(edges).select("node", F.array(F.col("node") % 10).alias("items")))
    return out.select("node", F.size("values").cast("long").alias("n_values"), F.col("values")[0].alias("least"))


@query(
    "g05_reachable",
    f"""WITH RECURSIVE e AS (SELECT * FROM ({_ARROWS}) WHERE src % 5 <> 3 AND dst % 5 <> 3), r AS (SELECT src AS source, src AS node FROM e UNION SELECT r.source, e.dst FROM r JOIN e ON r.node = e.src) SELECT source, node FROM r""",
)
def reachable(spark, sf_dir):
    edges = _arrows(spark, sf_dir)
    live = edges.where("src % 5 <> 3 AND dst % 5 <> 3").select(F.col("src").alias("node")).distinct()
    return G.reachable(edges, live, G.nodes_of(edges).where("node % 5 = 3")).select("source", "node")


@query("g06_cartesian", "SELECT a.r_name || '/' || b.r_name || '/' || c.r_regionkey AS combination FROM region a, region b, region c")
def cartesian(spark, sf_dir):
    lists = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"), F.array_sort(F.collect_list(F.col("r_regionkey").cast("string"))).alias("keys"))
    return lists.select(F.explode(S.cartesian_product("names", "names", "keys")).alias("c")).select(F.array_join("c", "/").alias("combination"))


@query("g07_power_set", "SELECT m AS mask, array_to_string(list_filter(['AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST'], lambda x, i: (m >> (i - 1)) & 1 = 1), ',') AS members FROM range(0, 32) AS t(m)")
def power_set(spark, sf_dir):
    lists = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    return lists.select(F.posexplode(S.power_set("names")).alias("mask", "set")).select(F.col("mask").cast("long").alias("mask"), F.array_join("set", ",").alias("members"))


@query("g08_combinations", "SELECT a.n_name || ',' || b.n_name || ',' || c.n_name AS combination FROM nation a, nation b, nation c WHERE a.n_name < b.n_name AND b.n_name < c.n_name")
def combinations(spark, sf_dir):
    lists = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return lists.select(F.explode(S.combinations("names", 3)).alias("c")).select(F.array_join("c", ",").alias("combination"))


_ORDERS = "SELECT " + " || ',' || ".join(f"{x}.r_name" for x in "abcde") + " AS permutation FROM " + ", ".join(f"region {x}" for x in "abcde")
_ORDERS += " WHERE " + " AND ".join(f"{x}.r_name <> {y}.r_name" for x in "abcde" for y in "abcde" if x < y)


@query("g09_permutations", _ORDERS)
def permutations(spark, sf_dir):
    lists = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    return lists.select(F.explode(S.permutations("names")).alias("c")).select(F.array_join("c", ",").alias("permutation"))


@query("g10_multiset_intersection", "SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def multiset(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), "l_returnflag")
    return S.multiset_intersection(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["k", "s"])


@query("g11_factorial_choose", "SELECT n, factorial(n::INTEGER)::DOUBLE AS factorial, (factorial(n::INTEGER) / (factorial((n // 2)::INTEGER) * factorial((n - n // 2)::INTEGER)))::DOUBLE AS half FROM (SELECT DISTINCT p_size % 21 AS n FROM part)")
def factorial(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 21).alias("n")).distinct()
    return rows.select("n", S.factorial("n").cast("double").alias("factorial"), S.choose(F.col("n"), F.floor(F.col("n") / 2).cast("int")).cast("double").alias("half"))


@query(
    "b15_exclusive_flags",
    """WITH f AS (SELECT user_id, arg_max(m, (ts, event_id)) FILTER (m IN (1, 2)) AS a, arg_max(m, (ts, event_id)) FILTER (m IN (4, 8)) AS b, max(m) FILTER (m = 16) AS c FROM (SELECT *, (1::BIGINT << (event_id % 5)) AS m FROM events) GROUP BY user_id)
SELECT user_id, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS flags FROM f""",
)
def exclusive(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("m", F.expr("shiftleft(1L, cast(event_id % 5 AS int))"))
    return G.exclusive_flags(rows, "user_id", ["ts", "event_id"], "m", [[1, 2], [4, 8]], "force")


@query(
    "b16_rule_flags",
    """WITH RECURSIVE o AS (SELECT user_id, (1::BIGINT << (event_id % 4)) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS flags FROM o UNION ALL
 SELECT o.user_id, o.n, CASE WHEN m = 2 AND flags & 1 = 0 THEN flags WHEN m = 8 AND (flags & 2 = 0 OR flags & 4 <> 0) THEN flags WHEN m = 4 AND flags & 8 <> 0 THEN flags ELSE flags | m END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, flags FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def rules(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("m", F.expr("shiftleft(1L, cast(event_id % 4 AS int))"))
    return G.rule_flags(rows, "user_id", ["ts", "event_id"], "m", {2: 1, 8: 2}, {8: 4})


@query(
    "b17_rule_conflicts",
    f"""WITH RECURSIVE e AS ({_ARROWS}), f AS (SELECT DISTINCT p_size % 25 AS flag, p_size * 3 % 25 AS bars FROM part), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
s AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT 'cycle' AS kind, component AS a, node AS b FROM s
UNION SELECT 'forbidden_dependency', a, b FROM r JOIN f ON r.a = flag AND r.b = bars WHERE a <> b
UNION SELECT 'barred_by_dependency', a, b FROM r JOIN f ON r.b = flag AND r.a = bars WHERE a <> b
UNION SELECT 'self', flag, bars FROM f WHERE flag = bars""",
)
def conflicts(spark, sf_dir):
    requires = _arrows(spark, sf_dir).withColumnsRenamed({"src": "flag", "dst": "needs"})
    forbids = table(spark, sf_dir, "part").select((F.col("p_size") % 25).alias("flag"), (F.col("p_size") * 3 % 25).alias("bars")).distinct()
    return G.consistency(requires, forbids)
