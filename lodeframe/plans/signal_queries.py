"""Easing, motion, geometry and matrices over lines, events and embeddings."""

from pyspark.sql import functions as F

from lodeframe.functions import geometry as M
from lodeframe.functions import signals as E
from lodeframe.operators import joins as J
from lodeframe.plans.registry import micros, query, table

_T = "(l_discount * 10)"
_SQL_CURVES = {
    "linear": "t", "quad": "t*t", "inverse_quad": "2*t-t*t", "cubic": "t*t*t", "inverse_cubic": "t*t*t-3*t*t+3*t", "quart": "t*t*t*t", "quint": "t*t*t*t*t", "sine": "1-cos(pi()/2*t)",
    "circle": "1-sqrt(greatest(1-t*t,0))", "inverse_circle": "sqrt(greatest(2*t-t*t,0))", "swing": "0.5-0.5*cos(pi()*t)", "smooth_bounce": "1-abs(cos(10*pi()*t)*exp(-6*t))", "linear_bounce": "1-abs(2*t-1)", "square": "sqrt(t)", "curves": "3*t*t-2*t*t*t",
    "quads": "CASE WHEN t<0.5 THEN 2*t*t ELSE 4*t-1-2*t*t END", "inverse_quads": "CASE WHEN t<0.5 THEN 2*t-2*t*t ELSE 1-2*t+2*t*t END", "cubics": "CASE WHEN t<0.5 THEN 4*t*t*t ELSE 4*t*t*t-12*t*t+12*t-3 END",
}


@query("e01_easing", f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({sql}, 9) + 0.0 AS {name}' for name, sql in _SQL_CURVES.items())}, round(pow(2, 10*(t-1)), 9) AS exponent, round(ln(1+t)/ln(2), 9) AS logarithm, round(2.70158*t*t*t-1.70158*t*t, 9) + 0.0 AS back FROM (SELECT *, least(greatest(round({_T}, 6), 0), 1) AS t FROM lineitem)")
def easing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.least(F.greatest(F.round(F.col("l_discount") * 10, 6), F.lit(0.0)), F.lit(1.0)))
    curves = {**{name: name for name in _SQL_CURVES}, "exponent": E.exponent(), "logarithm": E.logarithm(), "back": E.back()}
    return rows.select("l_orderkey", "l_linenumber", *((F.round(E.ease("t", curve), 9) + 0.0).alias(name) for name, curve in curves.items()))


@query(
    "e02_easing_options",
    """WITH x AS (SELECT l_orderkey, l_linenumber, least(greatest(round(l_discount * 10, 6), 0), 1) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 - (1 - t) * (1 - t), 9) AS out_quad, round(CASE WHEN t <= 0.5 THEN 2 * t * t ELSE 1 - 2 * (1 - t) * (1 - t) END, 9) AS in_out_quad,
 round(t * t * t * t, 9) AS strong_quad, round(pow(t, 6), 9) AS fast_cubic, round(2 * pow(t, 3) - pow(t, 6), 9) AS slow_cubic FROM x""",
)
def options(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.least(F.greatest(F.round(F.col("l_discount") * 10, 6), F.lit(0.0)), F.lit(1.0)))
    forms = {"out_quad": ("quad", "out", False, "normal"), "in_out_quad": ("quad", "in_out", False, "normal"), "strong_quad": ("quad", "in", True, "normal"), "fast_cubic": ("cubic", "in", False, "fast"), "slow_cubic": ("cubic", "in", False, "slow")}
    return rows.select("l_orderkey", "l_linenumber", *(F.round(E.ease("t", *form), 9).alias(name) for name, form in forms.items()))


@query(
    "e03_e04_time",
    """SELECT event_id, round(greatest(0, least(v, 65)), 6) AS clamped, round(v - 65 * floor(v / 65), 6) AS looped, round(CASE WHEN v - 130 * floor(v / 130) <= 65 THEN v - 130 * floor(v / 130) ELSE 130 - (v - 130 * floor(v / 130)) END, 6) AS swung,
 round((v - 65 * floor(v / 65)) / 65, 6) AS progress, v >= 65 AS finished FROM (SELECT event_id, value - 100 AS v FROM events)""",
)
def times(spark, sf_dir):
    v = F.col("value") - 100
    return table(spark, sf_dir, "events").select(
        "event_id",
        *(F.round(E.map_time(v, 65, b), 6).alias(name) for name, b in (("clamped", "clamp"), ("looped", "loop"), ("swung", "oscillate"))),
        F.round(E.progress(v, 65, "loop"), 6).alias("progress"),
        E.finished(v, 65, "clamp").alias("finished"),
    )


@query(
    "e05_e08_motion",
    """WITH s AS (SELECT c_custkey, c_acctbal / 100 AS v, (i * 0.5)::DOUBLE AS t FROM customer, range(0, 5) AS r(i))
SELECT c_custkey, t, 0 AS channel, round(v * t * 2 + 1, 6) AS position, round(v * 2, 6) AS velocity, 0.0::DOUBLE AS acceleration FROM s
UNION ALL SELECT c_custkey, t, 1, round((v * t + t * t) * 3, 6), round((v + 2 * t) * 3, 6), 6.0::DOUBLE FROM s""",
)
def motion(spark, sf_dir):
    rows = E.sample_times(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("v")), 0.0, 2.0, 4)
    fast = E.offset(E.time_scaled(E.uniform(F.col("t") * 2, 0.0, "v"), 2.0), 1.0)
    half = E.accelerated("t", 0.0, "v", 1.0)
    other = E.scaled(E.added(half, E.accelerated("t", 0.0, 0.0, 1.0)), 3.0)
    both = E.channels({0: rows.withColumn("s", fast), 1: rows.withColumn("s", other)})
    both = both.where(E.is_finite(F.col("s")))
    return both.select("c_custkey", "t", "channel", *(F.round(F.col(f"s.{x}"), 6).alias(x) for x in ("position", "velocity", "acceleration")))


@query(
    "e09_traffic_light",
    """WITH t AS (SELECT event_id, (epoch_us(ts) // 1000000) % 65 AS t FROM events) SELECT event_id, CASE WHEN t < 30 THEN 1 WHEN t < 35 THEN 2 ELSE 3 END AS light, (t - CASE WHEN t < 30 THEN 0 WHEN t < 35 THEN 30 ELSE 35 END)::DOUBLE AS local FROM t""",
)
def traffic_light(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", E.map_time(F.floor(micros("ts") / 1_000_000), 65, "loop").alias("t"))
    segments = spark.sql("SELECT * FROM VALUES (0.0D, 1), (30.0D, 2), (35.0D, 3) AS s(start, light)")
    return J.piecewise(points, segments, "t", "start", ("light",), 5.0).select("event_id", "light", "local")


@query("e10_jumps", "SELECT event_id FROM (SELECT event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS jump FROM events) WHERE jump > 50")
def jumps(spark, sf_dir):
    return E.jumps(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value", 50.0).select("event_id")


@query("m08_points", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 2 + 1) - x)), 6) AS shifted FROM embeddings")
def points(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    moved = M.subtract(M.add(M.multiply(v, 2), 1), v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.norm(v), 6).alias("norm"), F.round(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x), 6).alias("shifted"))


@query(
    "m09_m10_curves",
    """SELECT p_partkey, round(p_size * t, 6) AS line_x, round(p_size * t * t + 2 * t * (1 - t), 6) AS curve_x, round(2 * t * (1 - t) * 3, 6) AS curve_y FROM (SELECT p_partkey, p_size, (p_partkey % 11) / 10.0::DOUBLE AS t FROM part)""",
)
def curves(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), ((F.col("p_partkey") % 11) / 10.0).alias("t"))
    zero, middle, end = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(3.0)), F.array(F.col("s"), F.lit(0.0))
    rows = rows.select("p_partkey", M.line_at(zero, end, "t").alias("l"), M.bezier_at([zero, middle, end], "t").alias("b"))
    return rows.select("p_partkey", F.round(F.col("l")[0], 6).alias("line_x"), F.round(F.col("b")[0], 6).alias("curve_x"), F.round(F.col("b")[1], 6).alias("curve_y"))


@query("m01_m04_m05_coo", "WITH a AS (SELECT l_suppkey % 50 AS i, l_partkey % 40 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY 1, 2")
def coo(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 40).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return M.coo_multiply(a, M.coo_transpose(a))


@query(
    "m02_m03_m04_small",
    """SELECT p_partkey, round(s * 4 - 6, 6) AS det2, round(s + 4, 6) AS trace, round(4 / (s * 4 - 6), 9) AS inverse00, round(s * s + 6, 6) AS square00, round(s * 4 - 6, 6) AS det, 2.0::DOUBLE AS transposed01, 4.0::DOUBLE AS adjoint00 FROM (SELECT p_partkey, p_size + 2.0::DOUBLE AS s FROM part)""",
)
def small(spark, sf_dir):
    m = F.array(F.array(F.col("p_size") + 2.0, F.lit(3.0)), F.array(F.lit(2.0), F.lit(4.0)))
    rows = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return rows.select(
        "p_partkey",
        F.round(M.determinant2("m"), 6).alias("det2"),
        F.round(M.trace("m"), 6).alias("trace"),
        F.round(M.inverse("m")[0][0], 9).alias("inverse00"),
        F.round(M.matmul("m", "m")[0][0], 6).alias("square00"),
        F.round(M.determinant("m"), 6).alias("det"),
        M.transpose("m")[0][1].alias("transposed01"),
        F.round(M.adjoint("m")[0][0], 6).alias("adjoint00"),
    )


@query(
    "m05_m07_shapes",
    """SELECT p_partkey, 0.0::DOUBLE AS beyond, p_size::DOUBLE AS corner, round(2 * cos(0.5) * p_size - 3 * sin(0.5) + 1, 6) AS moved_x, round(2 * sin(0.5) * p_size + 3 * cos(0.5) + 2, 6) AS moved_y, p_size || ' 3' || chr(10) || '2 4' AS text, 3 * p_size::DOUBLE AS tripled FROM part""",
)
def shapes(spark, sf_dir):
    s = F.col("p_size").cast("double")
    m = F.array(F.array(s, F.lit(3.0)), F.array(F.lit(2.0), F.lit(4.0)))
    rows = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"), F.array(F.array(s), F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("v"))
    moved = M.matmul(M.affine(1.0, 2.0, 0.5, 2.0, 3.0), F.col("v"))
    large, small_ = M.resized("m", 3, 4), M.resized("m", 1, 1)
    tripled = M.map_matrix(M.matmul("m", M.identity(2)), lambda x: x * 3)
    return rows.select("p_partkey", large[2][3].alias("beyond"), small_[0][0].alias("corner"), F.round(moved[0][0], 6).alias("moved_x"), F.round(moved[1][0], 6).alias("moved_y"), M.render("m").alias("text"), tripled[0][0].alias("tripled"))


@query(
    "m11_units",
    """SELECT p_partkey, round(CASE WHEN p_size > 1 THEN ln(p_retailprice) / ln(p_size) END, 9) AS log_size, round(ln(p_size) / ln(2), 9) AS log_two, round(pow(p_size, 1.5), 6) AS raised, round(sqrt(p_retailprice), 9) AS root, abs(p_size - 25)::BIGINT AS apart, round(p_size * pi() + exp(1), 9) AS with_constants FROM part""",
)
def units(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(M.log_base("p_retailprice", "p_size"), 9).alias("log_size"),
        F.round(M.log_base(size, 2), 9).alias("log_two"),
        F.round(F.pow(size, F.lit(1.5)), 6).alias("raised"),
        F.round(F.sqrt("p_retailprice"), 9).alias("root"),
        F.abs(size - 25).cast("long").alias("apart"),
        F.round(size * F.pi() + F.e(), 9).alias("with_constants"),
    )
