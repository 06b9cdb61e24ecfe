"""Ordered maps, order statistics and bounded state as DataFrame operations.

A map is a DataFrame with one row a key; operations on it are joins, windows and aggregations, which Spark plans with partial
sums, ranks limited before the shuffle, or broadcasts, as sizes suggest.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from lodeframe.storage import kept


def insert_first(rows: DataFrame, key: str, order: str | list[str], value: str) -> DataFrame:
    """A map in which the first value of a key stays."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    return rows.groupBy(key).agg(F.min_by(value, by).alias(value))


def insert_last(rows: DataFrame, key: str, order: str | list[str], value: str) -> DataFrame:
    """A map in which the last value of a key wins."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    return rows.groupBy(key).agg(F.max_by(value, by).alias(value))


def try_emplace(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``held`` with the keys of ``new`` that it lacks."""
    return held.unionByName(new.join(held.select(key), key, "left_anti"))


def insert_or_assign(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``held`` with all keys of ``new``, whose values win."""
    return held.join(new.select(key), key, "left_anti").unionByName(new)


def erase(held: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return held.join(gone.select(key).distinct(), key, "left_anti")


def lookup(held: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Each asked row with the map's values, NULL where the key isn't there, and ``found``."""
    return asked.join(held.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges of ``order``, numbered ``_part``. They are written, so that all branches of a plan see the same ranges."""
    return kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def around(held: DataFrame, asked: DataFrame, key: str, probe: str) -> DataFrame:
    """The different probes with ``floor``, the greatest key up to the probe, ``lower``, the least key from it on, and ``upper``, the least
    key behind it; NULL where there is none.

    Both sides go into one ordered run; ranges of the key are sorted apart, and what stands beyond a range's ends are the nearest
    keys of other ranges, one row a range. All frames run from the start of the order, so each row is taken in once."""
    keys = held.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct()
    asks = asked.select(F.col(probe).alias("_k")).where("_k IS NOT NULL").distinct()
    marked = keys.select("_k", F.lit(1).alias("_is")).unionByName(asks.select("_k", F.lit(0).alias("_is")))
    parts = _ranges(marked.groupBy("_k").agg(F.max("_is").alias("_is")), "_k")
    own = F.when(F.col("_is") == 1, F.col("_k"))
    ends = parts.groupBy("_part").agg(F.min(own).alias("_first"), F.max(own).alias("_last"))
    up, down = Window.orderBy("_part"), Window.orderBy(F.desc("_part"))
    earlier = Window.unboundedPreceding, -1
    beyond = ends.select("_part", F.max("_last").over(up.rowsBetween(*earlier)).alias("_ahead"), F.min("_first").over(down.rowsBetween(*earlier)).alias("_behind"))
    rising, falling = Window.partitionBy("_part").orderBy("_k"), Window.partitionBy("_part").orderBy(F.desc("_k"))
    return parts.join(F.broadcast(beyond), "_part").select(
        F.col("_k").alias(probe),
        F.coalesce(F.max(own).over(rising.rowsBetween(Window.unboundedPreceding, 0)), "_ahead").alias("floor"),
        F.coalesce(F.min(own).over(falling.rowsBetween(Window.unboundedPreceding, 0)), "_behind").alias("lower"),
        F.coalesce(F.min(own).over(falling.rowsBetween(*earlier)), "_behind").alias("upper"),
    )


def bounds(held: DataFrame, asked: DataFrame, key: str, probe: str) -> DataFrame:
    """``asked`` with ``lower``, the least key from the probe on, and ``upper``, the least key behind it; NULL past the end."""
    return asked.join(around(held, asked, key, probe).select(probe, "lower", "upper"), probe, "left")


def neighbours(held: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Each key with its predecessor and successor, within groups if ``by`` is given, else in ranges of the key."""
    if by:
        order = Window.partitionBy(by).orderBy(key)
        return held.withColumn("predecessor", F.lag(key).over(order)).withColumn("successor", F.lead(key).over(order))
    parts = _ranges(held, key)
    ends = parts.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    line = Window.orderBy("_part")  # one row a range
    beyond = ends.select("_part", F.lag("_last").over(line).alias("_ahead"), F.lead("_first").over(line).alias("_behind"))
    order = Window.partitionBy("_part").orderBy(key)
    found = parts.join(F.broadcast(beyond), "_part")
    found = found.withColumn("predecessor", F.coalesce(F.lag(key).over(order), "_ahead"))
    return found.withColumn("successor", F.coalesce(F.lead(key).over(order), "_behind")).drop("_part", "_ahead", "_behind")


def kth(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The row of rank k, from 0, in each group; groups of k rows or fewer have none."""
    if k < 0:
        raise ValueError("ranks count from 0")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= k + 1).where(F.col("_place") == k + 1).drop("_place")


def rank_of(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``rows`` with ``rank``: how many rows of the group are less."""
    return rows.withColumn("rank", (F.rank().over(Window.partitionBy(group).orderBy(value)) - 1).cast("long"))


def rank_of_key(rows: DataFrame, asked: DataFrame, group: str, key: str) -> DataFrame:
    """For each asked key: how many keys of its group are less; the group's size where the group lacks the key."""
    counts = rows.groupBy(group, key).count()
    at = Window.partitionBy(group).orderBy(key)
    ranked = counts.select(group, key, F.coalesce(F.sum("count").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rank"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    out = asked.join(ranked, [group, key], "left").join(sizes, group, "left")
    return out.withColumn("rank", F.coalesce("_rank", "_size", F.lit(0))).drop("_rank", "_size")


def heap_tree(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """A binary tree filled level by level: ``node`` from 1, ``parent``, ``depth``, and which children there are."""
    at = Window.partitionBy(group)
    out = rows.withColumn("node", F.row_number().over(at.orderBy(*order)).cast("long")).withColumn("_n", F.count("*").over(at))
    return (
        out.withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))
        .withColumn("depth", (F.length(F.bin("node")) - 1).cast("long"))
        .withColumn("has_left", F.col("node") * 2 <= F.col("_n"))
        .withColumn("has_right", F.col("node") * 2 + 1 <= F.col("_n"))
        .drop("_n")
    )


def tree_shape(tree: DataFrame, group: str) -> DataFrame:
    """Per tree of nodes with ``depth``, ``node``, ``has_left`` and ``has_right``: height, size, leaves, and whether it is full (each node
    has no or two children), complete (filled level by level from the left) and balanced by number of levels."""
    return tree.groupBy(group).agg(
        (F.max("depth") + 1).cast("long").alias("height"),
        F.count("*").alias("size"),
        F.count_if(~F.col("has_left") & ~F.col("has_right")).alias("leaves"),
        F.bool_and(F.col("has_left") == F.col("has_right")).alias("is_full"),
        (F.max("node") == F.count("*")).alias("is_complete"),
        (F.count("*") >= F.expr("shiftleft(1L, cast(max(depth) AS int))")).alias("is_balanced"),
    )


# Sliding and bounded state.


def sliding_max(value, window: int, by: str, order: list[str]) -> Column:
    return F.max(value).over(_last(window, by, order))


def sliding_min(value, window: int, by: str, order: list[str]) -> Column:
    return F.min(value).over(_last(window, by, order))


def newest(value, window: int, by: str, order: list[str]) -> Column:
    return F.last(value).over(_last(window, by, order))


def last_rows(value, window: int, by: str, order: list[str]) -> Column:
    """The last values up to a ring's capacity, oldest first."""
    return F.collect_list(value).over(_last(window, by, order))


def _last(window: int, by: str, order: list[str]):
    if window < 1:
        raise ValueError("a window has one row at least")
    return Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0)


def ring(rows: DataFrame, by: str, order: list[str], operation: str, capacity: int) -> DataFrame:
    """Per ``by``, a queue that rejects when it is full: ``size``, ``accepted``, ``rejected`` and ``popped`` after "push" and "pop" rows in order.

    The queue's length is a walk between two walls, 0 and the capacity; it is folded over a group's operations in order."""
    ops = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(operation).alias("_op")))).alias("_ops"))
    start = F.struct(*(F.lit(0).cast("long").alias(x) for x in ("size", "accepted", "rejected", "popped")))

    def step(acc, x):
        push, pop = x["_op"] == "push", x["_op"] == "pop"
        fits, some = push & (acc["size"] < capacity), pop & (acc["size"] > 0)
        return F.struct(
            (acc["size"] + fits.cast("long") - some.cast("long")).alias("size"),
            (acc["accepted"] + fits.cast("long")).alias("accepted"),
            (acc["rejected"] + (push & ~fits).cast("long")).alias("rejected"),
            (acc["popped"] + some.cast("long")).alias("popped"),
        )

    return ops.select(by, F.aggregate("_ops", start, step).alias("_s")).select(by, "_s.*")


def lru_hits(rows: DataFrame, by: str, order: list[str], key: str, capacity: int) -> DataFrame:
    """``rows`` with ``hit``: whether a cache of least recently used keys would still hold the key.

    Rows stream through in order, with the keys of one group's cache as the only state, so a group of any length takes time in
    proportion to its rows and memory for ``capacity`` keys. A null key is a key like others."""
    if capacity < 1:
        raise ValueError("a cache holds one key at least")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cache = object(), OrderedDict()
        for batch in source:
            hits = []
            for owner, used in zip(batch.column(by).to_pylist(), batch.column(key).to_pylist(), strict=True):
                if owner != group:
                    group, cache = owner, OrderedDict()
                hits.append(used in cache)
                cache[used] = None
                cache.move_to_end(used)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    kept_rows = rows.drop("hit")
    schema = StructType([*kept_rows.schema.fields, StructField("hit", BooleanType())])
    return kept_rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(batches, schema)


def slot_ids(rows: DataFrame, by: str, order: list[str], operation: str, capacity: int, shift: int = 16) -> DataFrame:
    """Replays "insert" and "erase" rows (the latter free the group's oldest live slot) of a slot map with reuse of freed slots, last
    freed first; an id is the slot's generation shifted left, plus its index. Per group: live ids, and how many inserts
    found it full. The fold keeps per group only the capacity's slots."""
    ops = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(operation).alias("_op")))).alias("_ops"))
    slots = F.array_repeat(F.lit(1).cast("long"), capacity)
    free = F.transform(F.sequence(F.lit(0), F.lit(capacity - 1)), lambda i: (F.lit(capacity - 1) - i).cast("long"))
    start = F.struct(slots.alias("keys"), free.alias("free"), F.array().cast("array<bigint>").alias("live"), F.lit(0).cast("long").alias("full"))

    def step(acc, x):
        insert, erase_ = x["_op"] == "insert", x["_op"] == "erase"
        room, some = F.size(acc["free"]) > 0, F.size(acc["live"]) > 0
        index = F.element_at(acc["free"], -1)
        new_id = F.call_function("shiftleft", F.get(acc["keys"], index.cast("int")), F.lit(shift)) + index
        old = F.get(acc["live"], F.lit(0))
        old_index = old.bitwiseAND(F.lit((1 << shift) - 1).cast("long"))
        put, drop = insert & room, erase_ & some
        return F.struct(
            F.when(drop, F.transform(acc["keys"], lambda k, i: F.when(i == old_index, k + 1).otherwise(k))).otherwise(acc["keys"]).alias("keys"),
            F.when(put, F.slice(acc["free"], 1, F.size(acc["free"]) - 1)).when(drop, F.concat(acc["free"], F.array(old_index))).otherwise(acc["free"]).alias("free"),
            F.when(put, F.concat(acc["live"], F.array(new_id))).when(drop, F.slice(acc["live"], 2, F.greatest(F.size(acc["live"]) - 1, F.lit(0)))).otherwise(acc["live"]).alias("live"),
            (acc["full"] + (insert & ~room).cast("long")).alias("full"),
        )

    return ops.select(by, F.aggregate("_ops", start, step).alias("_s")).select(by, F.col("_s.live").alias("live"), F.col("_s.full").alias("full"))


def resized_max(rows: DataFrame, by: str, order: list[str], value: str, size: str, most: int) -> DataFrame:
    """``rows`` with ``greatest``, over a window whose size the rows set, ``most`` at most: a smaller one drops its oldest rows, and a
    larger one doesn't bring them back."""
    line = Window.partitionBy(by).orderBy(*order)
    out = rows.withColumn("_n", F.row_number().over(line))
    first = F.greatest(F.lit(1), F.col("_n") - F.least(F.greatest(F.col(size), F.lit(1)), F.lit(most)) + 1)
    out = out.withColumn("_first", F.max(first).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_recent", F.collect_list(F.struct(F.col(value).alias("v"))).over(line.rowsBetween(1 - most, 0)))
    held = F.slice("_recent", F.col("_first") - F.col("_n") - 1, F.col("_n") - F.col("_first") + 1)
    return out.withColumn("greatest", F.array_max(F.transform(held, lambda x: x["v"]))).drop("_n", "_first", "_recent")


def traversal(tree: DataFrame, group: str, kind: str) -> DataFrame:
    """``tree``, of nodes numbered level by level, with ``place``, from 0, in an order: "pre", "in", "post" or "level".

    A node's way from the root is the digits behind its number's first; with a mark for the node's own end that sorts before,
    between or behind those of left and right, the ways sort as each order visits."""
    way = F.substring(F.bin("node"), 2, 64)
    keys = {"pre": way, "in": F.concat(F.translate(way, "1", "2"), F.lit("1")), "post": F.concat(way, F.lit("2")), "level": F.col("node")}
    if kind not in keys:
        raise ValueError("the order is one of pre, in, post and level")
    return tree.withColumn("place", (F.row_number().over(Window.partitionBy(group).orderBy(keys[kind])) - 1).cast("long"))
