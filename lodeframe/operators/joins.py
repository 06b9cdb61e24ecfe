"""Joins that Spark has no operator for: overlap and containment of intervals, as-of, prefixes.

Each becomes an equi-join with a residual condition, so no nested loop over both sides is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.operators.ordered import around


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlapping(left: DataFrame, right: DataFrame, width: float, low: str = "low", high: str = "high", on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows whose closed intervals share a point, the right columns prefixed by ``other_``; ``on`` names equal columns.

    Intervals are dealt out to bins of ``width``; a pair meets once, in the first bin that both have. An interval much
    longer than the width takes many bins, so the width should be near the usual length."""
    if width <= 0:
        raise ValueError("bins need a width")
    a = left.where(F.col(low) <= F.col(high)).withColumn("_bin", _bins(F.col(low), F.col(high), width))
    b = right.select(*(F.col(c).alias(c if c in on else f"other_{c}") for c in right.columns)).where(F.col(f"other_{low}") <= F.col(f"other_{high}"))
    b = b.withColumn("_bin", _bins(F.col(f"other_{low}"), F.col(f"other_{high}"), width))
    met = a.join(b, [*on, "_bin"])
    first = F.greatest(F.floor(F.col(low) / width), F.floor(F.col(f"other_{low}") / width))
    return met.where((F.col(low) <= F.col(f"other_{high}")) & (F.col(f"other_{low}") <= F.col(high)) & (F.col("_bin") == first)).drop("_bin")


def contained(queries: DataFrame, stored: DataFrame, width: float, low: str = "low", high: str = "high", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a query interval and a stored one that lies in it."""
    pairs = overlapping(queries, stored, width, low, high, on)
    return pairs.where((F.col(f"other_{low}") >= F.col(low)) & (F.col(f"other_{high}") <= F.col(high)))


def has_overlap(queries: DataFrame, stored: DataFrame, width: float, key: str, low: str = "low", high: str = "high", on: tuple[str, ...] = ()) -> DataFrame:
    """The query rows, by their unique ``key``, that some stored interval overlaps.

    Of the stored intervals that begin up to a query's end, the one that ends last tells. So no pairs are made: both sides run in
    order within spans of ``width``, and each span begins with the greatest end of the spans before it, one row a span."""
    if width <= 0:
        raise ValueError("spans need a width")
    keyed = [*on] or ["_all"]
    a = queries.withColumn("_all", F.lit(0)).where(F.col(low) <= F.col(high))
    a = a.select(*keyed, key, F.col(high).alias("_at"), F.col(low).alias("_low"), F.lit(1).alias("_side"))
    b = stored.withColumn("_all", F.lit(0)).where(F.col(low) <= F.col(high))
    b = b.select(*keyed, F.col(low).alias("_at"), F.col(high).alias("_end"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_span", F.floor(F.col("_at") / width))
    spans = both.groupBy(*keyed, "_span").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keyed).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keyed, "_span", F.max("_end").over(before).alias("_carried"))
    inside = Window.partitionBy(*keyed, "_span").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    reach = both.withColumn("_reach", F.max("_end").over(inside)).where("_side = 1").join(carried, [*keyed, "_span"])
    hits = reach.where((F.col("_reach") >= F.col("_low")) | (F.col("_carried") >= F.col("_low")))
    return queries.join(hits.select(key), key, "left_semi")


def as_of(left: DataFrame, right: DataFrame, time: str, start: str, on: tuple[str, ...], values: tuple[str, ...], span: float, inclusive: bool = True) -> DataFrame:
    """``left`` with ``values`` of the last right row of equal ``on`` that starts at or before ``time`` (strictly before, if not inclusive).

    Both sides are sorted together by key and time, in spans of time so that a hot key is spread; each span begins
    with the last values of the spans before it, one row a key and span. Of right rows at the same time the greatest values win."""
    names = [*on, "_at", "_side", "_span"]
    at_l = F.col(time).cast("double")
    lefts = left.withColumn("_at", at_l).withColumn("_side", F.lit(1 if inclusive else 0)).withColumn("_span", F.floor(at_l / span))
    at_r = F.col(start).cast("double")
    packed = F.struct(*(F.col(v) for v in values)).alias("_values")
    rights = right.select(*on, at_r.alias("_at"), packed).where("_at IS NOT NULL").withColumn("_side", F.lit(0 if inclusive else 1)).withColumn("_span", F.floor(F.col("_at") / span))
    ends = rights.groupBy(*on, "_span").agg(F.max_by("_values", F.struct("_at", "_values")).alias("_values"))
    # Of a span that has left rows: the end values of the last span before it that has any.
    needed = lefts.select(*on, "_span").distinct().withColumn("_values", F.lit(None).cast(ends.schema["_values"].dataType)).withColumn("_need", F.lit(True))
    walk = needed.unionByName(ends.withColumn("_need", F.lit(False)))
    before = Window.partitionBy(*on).orderBy("_span").rangeBetween(Window.unboundedPreceding, -1)
    carried = walk.withColumn("_carried", F.last("_values", True).over(before)).where("_need").select(*on, "_span", "_carried")
    both = lefts.unionByName(rights.select(*on, "_at", "_side", "_span", "_values"), allowMissingColumns=True)
    last = F.last("_values", True).over(Window.partitionBy(*on, "_span").orderBy("_at", "_side", "_values").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("_own", last).where(F.col("_side") == (1 if inclusive else 0))
    out = own.join(carried, [*on, "_span"], "left").withColumn("_found", F.coalesce("_own", "_carried"))
    return out.select(*left.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def piecewise(points: DataFrame, segments: DataFrame, time: str, start: str, values: tuple[str, ...], span: float) -> DataFrame:
    """``points`` with the values of their segment, the last one that starts at or before, the first one if none does, and ``local``, the time since."""
    one = points.withColumn("_one", F.lit(0))
    parts = segments.withColumn("_one", F.lit(0)).withColumn("_start", F.col(start))
    found = as_of(one, parts, time, start, ("_one",), ("_start", *values), span)
    head = segments.select(F.min_by(F.struct(F.col(start).alias("_start"), *values), F.col(start)).alias("_head"))
    out = found.crossJoin(F.broadcast(head))  # one row
    pick = [F.coalesce(F.col(v), F.col(f"_head.{v}")).alias(v) for v in values]
    begin = F.coalesce("_start", "_head._start")
    return out.select(*points.columns, *pick, (F.col(time) - begin).alias("local"))


def prefix_join(keys: DataFrame, prefixes: DataFrame, key: str, prefix: str, longest: int) -> DataFrame:
    """All pairs of a key and a prefix that it starts with. Keys give out their heads of the lengths that prefixes have, up to ``longest``
    characters, which meet the prefixes by equality; longer prefixes are compared by their first ``longest`` characters and then whole.

    Both sides are sorted: Spark's estimate of a table's size leaves out what explode makes of it, so it would broadcast the heads."""
    asked = prefixes.withColumn("_head", F.left(prefix, F.lit(longest)))
    lengths = asked.agg(F.array_compact(F.collect_set(F.length("_head"))).alias("_lengths"))  # one row, ``longest`` + 1 numbers at most
    heads = keys.crossJoin(F.broadcast(lengths)).withColumn("_length", F.explode("_lengths")).where(F.col("_length") <= F.length(key))
    heads = heads.withColumn("_head", F.substring(F.col(key), F.lit(1), F.col("_length"))).drop("_lengths", "_length")
    return heads.hint("merge").join(asked, "_head").where(F.startswith(key, prefix)).drop("_head")


def longest_common_prefix(keys: DataFrame, queries: DataFrame, key: str, query: str) -> DataFrame:
    """``queries`` with ``common``: how long a head of the query is a head of some key.

    In byte order the keys next to the query on either side share the longest head with it, so no heads are given out."""
    near = around(keys, queries, key, query).select(query, "floor", "lower")
    common = F.greatest(*(F.coalesce(common_prefix_length(query, x), F.lit(0)) for x in ("floor", "lower")))
    found = near.join(queries.select(query).distinct(), query, "left_semi").select(query, common.alias("common"))
    return queries.join(found, query, "left").withColumn("common", F.coalesce("common", F.lit(0)))


def common_prefix_length(a, b) -> Column:
    """How many leading characters two texts share; NULL if one is NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).when(differs == 0, F.least(F.length(a), F.length(b))).cast("int")
