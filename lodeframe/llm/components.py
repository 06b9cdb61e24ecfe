"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``(a, b)``: the least node of its component.

    Each round points every node to the least of itself and its neighbours, follows the pointers to their ends by doubling, and
    puts the ends in place of the nodes; links within an end are done and leave, so each round has half the nodes at most. Sums
    go before the shuffles; what a hot node is joined with is one row."""
    order = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(links.where("a <> b").select(*order).distinct(), "component-links")
    rounds: list[DataFrame] = []
    while not rounds or edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        labels = written(labels, "component-labels")
        while True:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
            ahead = labels.join(jump, "label").select("node", F.col("end").alias("label"), (F.col("end") < F.col("label")).alias("moved"))
            ahead = written(ahead, "component-labels")
            drop_written(labels)
            labels = ahead
            if not ahead.where("moved").limit(1).count():
                break
        rounds.append(labels)
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("low"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("high"))
        between = edges.join(left, "a").join(right, "b").where("low <> high")
        between = between.select(F.col("low").alias("a"), F.col("high").alias("b"))
        between = written(between.select(*order).distinct(), "component-links")
        drop_written(edges)
        edges = between
    found = rounds[0].select("node", "label")
    for higher in rounds[1:]:
        higher = higher.select(F.col("node").alias("label"), F.col("label").alias("end"))
        found = found.join(higher, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    found = written(found, "component-labels")
    drop_written(edges, *rounds)
    return found
