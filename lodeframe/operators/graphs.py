"""Graphs as edge tables ``(src, dst)``: components, strong components, closures, reachability.

Labels spread by joins until nothing changes. Each round's table is written to the folder that executors share (the session's
spark.checkpoint.dir), so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.storage import dropped, kept, kept_counting


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label over all paths along the edges ``(src, dst)``, into ``dst``; nodes are those of ``labels`` alone."""
    last = None
    while True:
        near = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node", "left")
        new = new.select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("before"))
        new, changed = kept_counting(new, "label < before")
        if last is not None:
            dropped(last)
        last, labels = new, new.select("node", "label")
        if not changed:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node that any path, edges taken either way, leads to. A node without edges joins by a loop ``(n, n)``.

    Each round points every node to the least of itself and its neighbours, follows the pointers to their ends by doubling, and
    goes on with the edges between different ends, which are half the nodes at most."""
    pair = (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    left, more = kept_counting(edges.select(*pair).distinct())
    rounds: list[DataFrame] = []
    while not rounds or more:
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        labels = kept(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
        while True:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
            ahead = labels.join(jump, "label").select("node", F.col("end").alias("label"), (F.col("end") < F.col("label")).alias("moved"))
            ahead, moved = kept_counting(ahead, "moved")
            dropped(labels)
            labels = ahead
            if not moved:
                break
        rounds.append(labels)
        ends = left.join(labels.select(F.col("node").alias("src"), F.col("label").alias("low")), "src")
        ends = ends.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("high")), "dst").where("low <> high")
        onward, more = kept_counting(ends.select(F.col("low").alias("src"), F.col("high").alias("dst")).select(*pair).distinct())
        dropped(left)
        left = onward
    found = rounds[0].select("node", "label")
    for higher in rounds[1:]:
        higher = higher.select(F.col("node").alias("label"), F.col("label").alias("end"))
        found = found.join(higher, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    return found.withColumnRenamed("label", "component")


def component_stats(edges: DataFrame) -> DataFrame:
    """Per component: its size and its least and greatest node."""
    return components(edges).groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.max("node").alias("greatest"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node among those that reach each other.

    Rounds of colouring: the least label that reaches a node is its colour; from a colour's own node, the nodes of that colour
    that reach it are its strong component. These leave, and the rest goes on. Labels are ranked by hash, so a long way without
    cycles falls into pieces all along, not node by node from its least end: rounds are about the logarithm of the nodes."""
    left = kept(edges.select("src", "dst").distinct())
    open_nodes, more = kept_counting(nodes_of(left))
    own = F.struct(F.xxhash64("node").alias("rank"), "node").alias("label")
    done: DataFrame | None = None
    while more:
        colours = _spread(left, open_nodes.select("node", own))
        # Backward within colours from each colour's own node.
        inside = left.join(colours.select(F.col("node").alias("src"), F.col("label").alias("_s")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("_d")), "dst").where("_s = _d")
        inside = kept(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seeds = colours.select("node", F.when(F.col("node") == F.col("label.node"), 0).otherwise(1).alias("label"))
        reached = _spread(inside, seeds).where("label = 0").select("node")
        found = kept(colours.join(reached, "node", "left_semi").select("node", F.col("label.node").alias("seed")))
        done = found if done is None else done.unionByName(found)
        open_nodes, more = kept_counting(open_nodes.join(found, "node", "left_anti"))
        left = kept(left.join(open_nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    if done is None:
        return open_nodes.select("node", F.col("node").alias("component"))
    least = done.groupBy("seed").agg(F.min("node").alias("component"))
    return done.join(least, "seed").select("node", "component")


def condensed_order(edges: DataFrame) -> DataFrame:
    """Strong components with their weak component and ``level``: the longest way of edges between strong components that leads
    there, so ascending levels are a topological order."""
    strong = kept(strong_components(edges))
    weak = components(edges.unionByName(nodes_of(edges).select(F.col("node").alias("src"), F.col("node").alias("dst")))).withColumnRenamed("component", "weak")
    s, d = strong.select(F.col("node").alias("src"), F.col("component").alias("_s")), strong.select(F.col("node").alias("dst"), F.col("component").alias("_d"))
    links = kept(edges.join(s, "src").join(d, "dst").where("_s <> _d").select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct())
    levels = kept(strong.select(F.col("component").alias("node")).distinct().withColumn("label", F.lit(0)))
    while True:
        pushed = links.join(levels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("label") + 1).alias("pushed"))
        new = levels.join(pushed, "node", "left")
        new = new.select("node", F.greatest("label", F.coalesce("pushed", F.lit(0))).alias("label"), F.col("label").alias("before"))
        new, changed = kept_counting(new, "label > before")
        levels = new.select("node", "label")
        if not changed:
            break
    return strong.join(weak, "node").join(levels.select(F.col("node").alias("component"), F.col("label").alias("level")), "component").select("node", "component", "weak", "level")


def reachable(edges: DataFrame, sources: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """``(source, node, distance)`` for all nodes on paths from ``sources(node)``, itself included, that avoid the ``deleted(node)``."""
    if deleted is not None:
        edges = edges.join(deleted.withColumnRenamed("node", "src"), "src", "left_anti").join(deleted.withColumnRenamed("node", "dst"), "dst", "left_anti")
        sources = sources.join(deleted, "node", "left_anti")
    edges = kept(edges.select("src", "dst").distinct())
    seen = kept(sources.distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("distance")))
    front, distance = seen, 0
    while True:
        distance += 1
        ahead = front.join(edges, front["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        ahead = ahead.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        front, more = kept_counting(ahead.withColumn("distance", F.lit(distance)))
        if not more:
            return seen
        seen = seen.unionByName(front)


def closure_union(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(node, values)``: the union of the arrays ``values(node, items)`` over all nodes that a node reaches, itself included.

    Strong components stand for their nodes, and items go against the edges between them, a step a round: what is kept is
    the items of a component, not the nodes that it reaches."""
    loops = values.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    every = edges.select("src", "dst").unionByName(loops)
    strong = kept(strong_components(every))
    src, dst = (strong.select(F.col("node").alias(x), F.col("component").alias(f"_{x}")) for x in ("src", "dst"))
    links = edges.join(src, "src").join(dst, "dst").where("_src <> _dst")
    links = kept(links.select(F.col("_src").alias("component"), F.col("_dst").alias("ahead")).distinct())
    items = values.join(strong, "node").select("component", F.explode("items").alias("item"))
    held, more = kept_counting(items.distinct())
    fresh = held
    while more:
        passed = links.join(fresh.withColumnRenamed("component", "ahead"), "ahead").select("component", "item").distinct()
        fresh, more = kept_counting(passed.join(held, ["component", "item"], "left_anti"))
        held = held.unionByName(fresh)
    lists = held.groupBy("component").agg(F.array_sort(F.collect_list("item")).alias("values"))
    return strong.join(lists, "component").select("node", "values")


def has_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with ``connected``."""
    reach = reachable(edges, pairs.select(F.col("src").alias("node"))).select(F.col("source").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("connected"))
    return pairs.join(reach, ["src", "dst"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


# Rule-constrained flags.


def consistency(requires: DataFrame, forbids: DataFrame) -> DataFrame:
    """Conflicts of rules ``requires(flag, needs)`` and ``forbids(flag, bars)``: ``(kind, a, b)`` with kinds "cycle" (flags that need each
    other), "forbidden_dependency" (a needs, perhaps through others, what it bars), "barred_by_dependency" (what a needs bars a), and "self"."""
    edges = requires.select(F.col("flag").alias("src"), F.col("needs").alias("dst"))
    strong = strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    big = strong.withColumn("_n", F.count("*").over(Window.partitionBy("component"))).where("_n > 1").select("node", "component")
    cycles = big.unionByName(loops.join(big.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    reach = kept(reachable(edges, nodes_of(edges)).where("source <> node").select(F.col("source").alias("flag"), F.col("node").alias("other")))
    forward = reach.join(forbids.select("flag", F.col("bars").alias("other")), ["flag", "other"])
    backward = reach.join(forbids.select(F.col("flag").alias("other"), F.col("bars").alias("flag")), ["flag", "other"])
    rows = [
        cycles.select(F.lit("cycle").alias("kind"), F.col("component").alias("a"), F.col("node").alias("b")),
        forward.select(F.lit("forbidden_dependency"), "flag", "other"),
        backward.select(F.lit("barred_by_dependency"), "flag", "other"),
        forbids.where("flag = bars").select(F.lit("self"), "flag", "bars"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out.distinct()


def merged_groups(groups: list[list[int]]) -> list[int]:
    """Masks of exclusion groups, those that share a flag joined."""
    masks: list[int] = []
    for group in groups:
        mask = 0
        for flag in group:
            mask |= flag
        for other in [m for m in masks if m & mask]:
            masks.remove(other)
            mask |= other
        masks.append(mask)
    return sorted(masks)


def exclusive_flags(rows: DataFrame, by: str, order: list[str], flag: str, groups: list[list[int]], policy: str = "force") -> DataFrame:
    """``(by, flags)``: each group's flags added in order. Of an exclusion group one flag can be set: another one replaces it ("force"),
    is left out ("reject"), or raises ("exception")."""
    if policy not in ("force", "reject", "exception"):
        raise ValueError("the policy is one of force, reject and exception")
    masks = merged_groups(groups)
    ops = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(flag).cast("long").alias("_flag")))).alias("_ops"))

    def step(acc, x):
        f = x["_flag"]
        rivals = F.lit(0).cast("long")
        for m in masks:
            m = F.lit(m).cast("long")
            rivals = F.when(f.bitwiseAND(m) != 0, m.bitwiseAND(F.bitwise_not(f))).otherwise(rivals)
        clash = acc.bitwiseAND(rivals) != 0
        free = acc.bitwiseOR(f)
        if policy == "force":
            return acc.bitwiseAND(F.bitwise_not(rivals)).bitwiseOR(f)
        if policy == "reject":
            return F.when(clash, acc).otherwise(free)
        return F.when(clash, F.raise_error(F.lit("two flags of one exclusion group")).cast("long")).otherwise(free)

    return ops.select(by, F.aggregate("_ops", F.lit(0).cast("long"), step).alias("flags"))


def rule_flags(rows: DataFrame, by: str, order: list[str], flag: str, requires: dict[int, int], forbids: dict[int, int], policy: str = "reject") -> DataFrame:
    """``(by, flags)``: flags added in order under rules by flag: masks that it needs and masks that it bars (either way).

    With "reject" a flag whose needs aren't met, or that clashes, is left out; with "force" its needs are added, through all
    steps, and what clashes is removed."""
    if policy not in ("force", "reject"):
        raise ValueError("the policy is one of force and reject")
    known = sorted({*requires, *forbids, *(1 << i for m in [*requires.values(), *forbids.values()] for i in range(m.bit_length()) if m >> i & 1)})

    def needs(f: int) -> int:
        out, before = requires.get(f, 0), -1
        while out != before:
            before = out
            for g in known:
                if out & g:
                    out |= requires.get(g, 0)
        return out & ~f

    def bars(mask: int) -> int:
        out = 0
        for g in known:
            if mask & g:
                out |= forbids.get(g, 0)
            if forbids.get(g, 0) & mask:
                out |= g
        return out

    ops = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(flag).cast("long").alias("_flag")))).alias("_ops"))

    def step(acc, x):
        f = x["_flag"]
        out = acc.bitwiseOR(f)  # a flag without rules
        for g in known:
            need = needs(g) if policy == "force" else requires.get(g, 0)
            bar = bars(g | need) if policy == "force" else bars(g)
            if policy == "force":
                added = acc.bitwiseAND(F.bitwise_not(F.lit(bar).cast("long"))).bitwiseOR(F.lit(g | need).cast("long"))
            else:
                ok = (acc.bitwiseAND(F.lit(need).cast("long")) == need) & (acc.bitwiseAND(F.lit(bar).cast("long")) == 0)
                added = F.when(ok, acc.bitwiseOR(F.lit(g).cast("long"))).otherwise(acc)
            out = F.when(f == g, added).otherwise(out)
        return out

    return ops.select(by, F.aggregate("_ops", F.lit(0).cast("long"), step).alias("flags"))
