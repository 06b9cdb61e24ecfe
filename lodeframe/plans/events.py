"""Sliding and bounded-state queries over the event table."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.plans.registry import query, table


@query(
    "t01_sliding_max",
    """SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sliding_max FROM events""",
)
def sliding_max(spark, sf_dir):
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max("value").over(frame).alias("sliding_max"))
