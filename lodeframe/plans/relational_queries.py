"""Ordered maps, sliding state, interval, as-of and prefix joins over the tables."""

from pyspark.sql import functions as F

from lodeframe.operators import joins as J
from lodeframe.operators import ordered as O
from lodeframe.plans.registry import micros, query, table


@query("s01_s02_first_last_wins", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id")
def first_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.col("event_id"))
    first = O.insert_first(rows, "user_id", ["ts", "event_id"], "value").withColumnRenamed("value", "first_event")
    return first.join(O.insert_last(rows, "user_id", ["ts", "event_id"], "value").withColumnRenamed("value", "last_event"), "user_id")


@query("s02_s03_assign_erase", "SELECT p_partkey, CASE WHEN p_size > 40 THEN -1 ELSE p_size END::INTEGER AS p_size FROM part WHERE p_size > 5")
def assign_erase(spark, sf_dir):
    held = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = held.where("p_size > 40").select("p_partkey", F.lit(-1).alias("p_size"))
    return O.erase(O.try_emplace(O.insert_or_assign(held, new, "p_partkey"), new, "p_partkey"), held.where("p_size <= 5"), "p_partkey")


@query("s04_lookup", "SELECT l_orderkey, l_linenumber, p_name, p_partkey IS NOT NULL AS found FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def lookup(spark, sf_dir):
    held = table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey", "p_name")
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return O.lookup(held, asked, "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "found")


@query(
    "s05_bounds",
    """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT c_custkey, l.k AS lower, u.k AS upper FROM customer ASOF LEFT JOIN k l ON c_custkey <= l.k ASOF LEFT JOIN k u ON c_custkey < u.k""",
)
def bounds(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select("o_custkey")
    return O.bounds(held, table(spark, sf_dir, "customer").select("c_custkey"), "o_custkey", "c_custkey").select("c_custkey", "lower", "upper")


@query("s06_s07_neighbours", "SELECT o_orderkey, lag(o_orderkey) OVER w AS predecessor, lead(o_orderkey) OVER w AS successor FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def neighbours(spark, sf_dir):
    return O.neighbours(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").drop("o_custkey")


@query(
    "s08_s09_tree_shape",
    """WITH t AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, (length(bin(max(n))))::BIGINT AS height, max(n) AS size, count(*) FILTER (2 * i > n) AS leaves, max(n) % 2 = 1 AS is_full, true AS is_complete, true AS is_balanced FROM t GROUP BY c_nationkey""",
)
def tree_shape(spark, sf_dir):
    return O.tree_shape(O.heap_tree(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"]), "c_nationkey")


@query("s11_kth", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 5")
def kth(spark, sf_dir):
    return O.kth(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", ["c_acctbal", "c_custkey"], 4)


@query(
    "s12_rank",
    """WITH a AS (SELECT c_nationkey, c_custkey + (c_custkey % 2) AS k FROM customer)
SELECT a.c_nationkey, a.k AS c_custkey, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = a.c_nationkey AND c.c_custkey = a.k)
 THEN (SELECT count(*) FROM customer c WHERE c.c_nationkey = a.c_nationkey AND c.c_custkey < a.k) ELSE (SELECT count(*) FROM customer c WHERE c.c_nationkey = a.c_nationkey) END AS rank FROM a""",
)
def rank_of_key(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return O.rank_of_key(rows, rows.withColumn("c_custkey", F.col("c_custkey") + F.col("c_custkey") % 2), "c_nationkey", "c_custkey")


_SPANS = "SELECT user_id, event_type, event_id AS id, (epoch_us(ts) // 1000000) AS low, (epoch_us(ts) // 1000000) + 3600 + (event_id % 7) * 600 AS high FROM events"


def _spans(spark, sf_dir):
    low = F.floor(micros("ts") / 1_000_000)
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), low.alias("low"), (low + 3600 + (F.col("event_id") % 7) * 600).alias("high"))


@query("s13_s14_overlaps", f"WITH s AS ({_SPANS}) SELECT a.id, b.id AS other_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.id < b.id AND a.low <= b.high AND b.low <= a.high")
def overlaps(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return J.overlapping(s, s, 7200, on=("user_id",)).where("id < other_id").select("id", "other_id")


@query("s15_contained", f"WITH s AS ({_SPANS}) SELECT a.id, b.id AS other_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.id <> b.id AND b.low >= a.low AND b.high <= a.high")
def contained(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return J.contained(s, s, 7200, on=("user_id",)).where("id <> other_id").select("id", "other_id")


@query("s16_has_overlap", f"WITH s AS ({_SPANS}) SELECT a.id FROM s a WHERE a.event_type = 'purchase' AND EXISTS (SELECT 1 FROM s b WHERE b.event_type <> 'purchase' AND a.user_id = b.user_id AND a.low <= b.high AND b.low <= a.high)")
def has_overlap(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return J.has_overlap(s.where("event_type = 'purchase'"), s.where("event_type <> 'purchase'"), 7200, "id", on=("user_id",)).select("id")


@query("s17_flat_map", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1] AS first_key, count(*)::BIGINT AS n_keys, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY o_custkey")
def flat_map(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))).alias("m"))
    return rows.select("o_custkey", F.map_keys("m")[0].alias("first_key"), F.size("m").cast("long").alias("n_keys"), F.element_at(F.map_values("m"), -1).alias("last_value"))


@query(
    "t02_t03_sliding",
    """SELECT event_id, min(value) OVER w AS least, last(value) OVER w AS newest, count(*) OVER w AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def sliding(spark, sf_dir):
    order = ["ts", "event_id"]
    return table(spark, sf_dir, "events").select("event_id", O.sliding_min("value", 10, "user_id", order).alias("least"), O.newest("value", 10, "user_id", order).alias("newest"), F.size(O.last_rows("value", 10, "user_id", order)).cast("long").alias("size"))


@query(
    "t04_ring",
    """WITH RECURSIVE o AS (SELECT user_id, event_type <> 'purchase' AND event_id % 3 <> 0 AS push, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS size, 0::BIGINT AS accepted, 0::BIGINT AS rejected, 0::BIGINT AS popped FROM (SELECT DISTINCT user_id FROM o)
 UNION ALL SELECT o.user_id, o.n, CASE WHEN push AND size < 4 THEN size + 1 WHEN NOT push AND size > 0 THEN size - 1 ELSE size END, accepted + (push AND size < 4)::INT, rejected + (push AND size >= 4)::INT, popped + (NOT push AND size > 0)::INT
 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, size, accepted, rejected, popped FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def ring(spark, sf_dir):
    push = (F.col("event_type") != "purchase") & (F.col("event_id") % 3 != 0)
    return O.ring(table(spark, sf_dir, "events").withColumn("op", F.when(push, "push").otherwise("pop")), "user_id", ["ts", "event_id"], "op", 4)


@query(
    "t05_lru_hits",
    """WITH o AS (SELECT event_id, user_id, (event_id * 7 % 17) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(n) OVER (PARTITION BY user_id, k ORDER BY n) AS b FROM o)
SELECT p.event_id, p.b IS NOT NULL AND (SELECT count(DISTINCT q.k) FROM o q WHERE q.user_id = p.user_id AND q.n > p.b AND q.n < p.n) < 5 AS hit FROM p""",
)
def lru_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 7 % 17).alias("k"))
    return O.lru_hits(rows, "user_id", ["ts", "event_id"], "k", 5).select("event_id", "hit")


@query(
    "t06_slot_map",
    """WITH RECURSIVE o AS (SELECT user_id, event_id % 3 = 0 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[] AS keys, [7, 6, 5, 4, 3, 2, 1, 0]::BIGINT[] AS free, []::BIGINT[] AS live, 0::BIGINT AS full FROM o
 UNION ALL SELECT o.user_id, o.n,
  CASE WHEN gone AND len(live) > 0 THEN list_transform(keys, lambda k, i: k + (i - 1 = live[1] % 65536)::BIGINT) ELSE keys END,
  CASE WHEN gone AND len(live) > 0 THEN list_append(free, live[1] % 65536) WHEN NOT gone AND len(free) > 0 THEN free[:len(free) - 1] ELSE free END,
  CASE WHEN gone AND len(live) > 0 THEN live[2:] WHEN NOT gone AND len(free) > 0 THEN list_append(live, keys[free[len(free)] + 1] * 65536 + free[len(free)]) ELSE live END,
  r.full + (NOT gone AND len(free) = 0)::BIGINT
 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, array_to_string(live, ',') AS live, r.full AS rejected FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def slot_map(spark, sf_dir):
    op = F.when(F.col("event_id") % 3 == 0, "erase").otherwise("insert")
    rows = O.slot_ids(table(spark, sf_dir, "events").withColumn("op", op), "user_id", ["ts", "event_id"], "op", 8)
    return rows.select("user_id", F.array_join(F.col("live").cast("array<string>"), ",").alias("live"), F.col("full").alias("rejected"))


@query(
    "e09_as_of_segments",
    """WITH s AS (SELECT user_id, ts AS start, value AS level FROM events WHERE event_type = 'purchase'), s1 AS (SELECT user_id, start, max(level) AS level FROM s GROUP BY 1, 2)
SELECT event_id, s1.level FROM events e ASOF LEFT JOIN s1 ON e.user_id = s1.user_id AND e.ts >= s1.start""",
)
def as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("ts"), "event_type", "value")
    segments = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("value").alias("level"))
    return J.as_of(events.select("event_id", "user_id", "ts"), segments, "ts", "start", ("user_id",), ("level",), 86_400e6).select("event_id", "level")


@query("x01_x03_prefixes", "WITH q AS (SELECT DISTINCT p_name[1:5] AS prefix FROM part) SELECT prefix, count(*)::BIGINT AS n, min(p_name) AS first_key, max(p_partkey) AS greatest FROM q JOIN part ON starts_with(p_name, prefix) GROUP BY prefix")
def prefixes(spark, sf_dir):
    """Each different name meets the prefixes once, with the number and the greatest key of its parts."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = parts.select(F.left("p_name", F.lit(5)).alias("prefix")).distinct()
    names = parts.groupBy("p_name").agg(F.count("*").alias("n"), F.max("p_partkey").alias("greatest"))
    return J.prefix_join(names, asked, "p_name", "prefix", 8).groupBy("prefix").agg(F.sum("n").alias("n"), F.min("p_name").alias("first_key"), F.max("greatest").alias("greatest"))


@query("x04_prefix_contains", "SELECT a.p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name[1:3] || a.p_name[4:])")
def prefix_contains(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    asked = parts.select("p_partkey", F.concat(F.left("p_name", F.lit(3)), F.substring("p_name", 4, 1000)).alias("p_name"))
    return asked.join(parts.select("p_name"), "p_name", "left_semi").select("p_partkey")


@query(
    "x05_x06_common_prefix",
    """WITH h AS (SELECT DISTINCT p_name[1:i] AS head FROM part, range(1, 80) AS t(i) WHERE i <= length(p_name)),
q AS (SELECT p_partkey, p_brand, p_name[1:1 + p_partkey % 8] || '~' AS name FROM part)
SELECT p_partkey, coalesce((SELECT max(length(head)) FROM h WHERE starts_with(name, head)), 0)::INTEGER AS common,
 coalesce(list_max(list_filter(range(1, 80), lambda i: i <= least(length(name), length(p_brand)) AND name[1:i] = p_brand[1:i])), 0)::INTEGER AS with_brand FROM q""",
)
def common_prefix(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    asked = parts.select("p_partkey", "p_brand", F.concat(F.left("p_name", (1 + F.col("p_partkey") % 8).cast("int")), F.lit("~")).alias("name"))
    found = J.longest_common_prefix(parts.select(F.col("p_name").alias("key")), asked, "key", "name")
    return found.select("p_partkey", "common", J.common_prefix_length("name", "p_brand").alias("with_brand"))


@query(
    "t03_resized_window",
    """WITH o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 1 + event_id % 5 AS size FROM events),
r AS (SELECT *, max(greatest(1, n - size + 1)) OVER (PARTITION BY user_id ORDER BY n) AS f FROM o)
SELECT event_id, (SELECT max(value) FROM o q WHERE q.user_id = r.user_id AND q.n BETWEEN r.f AND r.n) AS greatest FROM r""",
)
def resized_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", (1 + F.col("event_id") % 5).cast("int").alias("size"))
    return O.resized_max(rows, "user_id", ["ts", "event_id"], "value", "size", 5).select("event_id", "greatest")


@query(
    "s07_traversals",
    """WITH t AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), w AS (SELECT *, bin(i)[2:] AS way FROM t)
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY way) - 1 AS pre, row_number() OVER (PARTITION BY c_nationkey ORDER BY replace(way, '1', '2') || '1') - 1 AS inside,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY way || '2') - 1 AS post, i - 1 AS level FROM w""",
)
def traversals(spark, sf_dir):
    tree = O.heap_tree(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"])
    for kind, name in (("pre", "pre"), ("in", "inside"), ("post", "post"), ("level", "level")):
        tree = O.traversal(tree, "c_nationkey", kind).withColumnRenamed("place", name)
    return tree.select("c_custkey", "pre", "inside", "post", "level")


@query("x07_lower_bound", "WITH k AS (SELECT DISTINCT p_name AS k FROM part), q AS (SELECT DISTINCT p_name[1:4] || 'm' AS probe FROM part) SELECT probe, l.k AS lower FROM q ASOF LEFT JOIN k l ON probe <= l.k")
def lower_bound(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_name")
    asked = parts.select(F.concat(F.left("p_name", F.lit(4)), F.lit("m")).alias("probe")).distinct()
    return O.bounds(parts, asked, "p_name", "probe").select("probe", "lower")
