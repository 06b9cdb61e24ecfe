"""All registered library queries."""

from lodeframe.plans import bit_queries, codec_queries, color_queries, events, graph_queries, relational_queries, signal_queries, syntax_queries, text_queries, tower_queries
from lodeframe.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "bit_queries", "codec_queries", "color_queries", "events", "graph_queries", "relational_queries", "signal_queries", "syntax_queries", "text_queries", "tower_queries"]

FLAGSHIP = "t01_sliding_max"
